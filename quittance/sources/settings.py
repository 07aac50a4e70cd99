"""Settings: defaults, then a packaged file, then the user's, merged key by key."""

from __future__ import annotations

import json
from pathlib import Path


class ConfigError(RuntimeError):
    pass


DEFAULTS: dict = {"currency": "IDR", "currencies": ["IDR", "USD"], "categories": [], "mail": {"min_attachment_bytes": 8192}, "output": {"template": "{stem}_{hash8}", "archive": True}}


def deep_merge(base: dict, over: dict) -> dict:
    """over on base; where both hold dicts, merged the same way; anything else replaced. Neither is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(packaged: Path | None = None, user: Path | None = None) -> dict:
    out = DEFAULTS
    for path in (packaged, user):
        if path and Path(path).exists():
            try:
                found = json.loads(Path(path).read_text(encoding="utf-8"))
            except (OSError, ValueError) as e:
                raise ConfigError(f"{path}: {e}") from e
            if not isinstance(found, dict):
                raise ConfigError(f"{path}: not an object")
            out = deep_merge(out, found)
    default = str(out["currency"]).upper()
    codes = [str(c).upper() for c in out["currencies"]]
    return out | {"currency": default, "currencies": list(dict.fromkeys(codes if default in codes else [default, *codes]))}
