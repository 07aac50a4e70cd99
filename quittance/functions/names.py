"""Merchants, categories and safe names, as native column expressions; Unicode folding by Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed
from .money import contains_any, let, lines_of


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def _beyond_ascii(text: Column) -> Column:
    """text where it isn't ASCII, else null, so that Python is handed nothing else."""
    return F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text)


def normalize(text: Column) -> Column:
    """NFKC; no built-in function has it. ASCII text, which it leaves as it is, stays in the JVM."""
    return F.coalesce(_nfkc(_beyond_ascii(text)), text)


def normalize_title(text: Column) -> Column:
    """NFKC, case folded, white space collapsed; '' for null. ASCII text stays in the JVM."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.coalesce(_folded(_beyond_ascii(text)), plain)


def extract_name(text: Column) -> Column:
    """The merchant: the best of the first ten lines, null without one. Lines near the top, long and in capitals score."""
    lines = F.transform(F.slice(lines_of(text), 1, 10), lambda x, i: F.struct(F.btrim(x, F.lit(" *=-_|.,:'\"")).alias("line"), i.alias("i")))
    letters = lambda s: F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    rows = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["i"].alias("i"), F.lower(x["line"]).alias("low"), F.filter(F.split(x["line"], r"\s+"), lambda t: t != "").alias("tokens"), letters(x["line"]).alias("letters")))

    def fits(x):
        size = F.length(x["line"])
        stubs = F.size(F.filter(x["tokens"], lambda t: F.length(t) <= 2))
        word = F.exists(x["tokens"], lambda t: (F.length(t) >= 4) & F.regexp_like(t, F.lit(r"^\p{L}+$")))
        return (size >= 3) & ~contains_any(x["low"], fixed.NOT_NAME) & (x["letters"] >= 3) & (x["letters"] >= size * 0.5) & ~F.regexp_like(x["low"], F.lit(fixed.HEADER_ADDRESS)) & word & (stubs / F.greatest(F.size(x["tokens"]), F.lit(1)) <= 0.4)

    capitals = lambda s: F.when((F.upper(s) == s) & (F.lower(s) != s), 20).otherwise(0)
    scored = F.transform(F.filter(rows, fits), lambda x: F.struct(((10 - x["i"]) * 5 + F.least(F.length(x["line"]), F.lit(40)) + capitals(x["line"])).alias("score"), x["line"].alias("line")))
    return F.left(F.array_max(scored)["line"], F.lit(120))


def guess_category(text: Column, allowed: list[str]) -> Column:
    """The allowed category whose words found in the text have most letters, the first on ties; without any the fallback."""
    none = fixed.OTHER_CATEGORY if fixed.OTHER_CATEGORY in allowed else allowed[-1] if allowed else ""
    known = [(-rank, c, words) for rank, (c, words) in enumerate(fixed.CATEGORY_WORDS.items()) if c in allowed]
    if not known:
        return F.lit(none)

    def scores(low):
        score = lambda words: sum((F.when(F.contains(low, F.lit(w)), len(w)).otherwise(0) for w in words), F.lit(0))
        return F.array_max(F.array(*[F.struct(score(words).alias("score"), F.lit(rank).alias("rank"), F.lit(c).alias("category")) for rank, c, words in known]))

    return let(let(F.lower(F.coalesce(text, F.lit(""))), scores), lambda best: F.when(best["score"] > 0, best["category"]).otherwise(none))


def trim_address(value: Column, limit: int = 70) -> Column:
    """Up to the first address mark and the first comma, spaces collapsed."""
    at = F.regexp_instr(value, F.lit(fixed.ADDRESS))
    value = F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value)
    value = F.regexp_replace(F.split_part(value, F.lit(","), F.lit(1)), r"\s+", " ")
    return F.left(F.btrim(value, F.lit(" -–—,:")), F.lit(limit))


def merchant_guess(body: Column, sender: Column, address: Column) -> Column:
    """What the first line that names a merchant says, else the sender's name, else their address."""

    def value(x):
        tried = []
        for start in fixed.MERCHANT_STARTS:
            rest = F.when(F.contains(x, F.lit(":")), F.regexp_replace(x, r"^[^:]*:", "")).otherwise(F.substring(x, len(start) + 1, 1 << 20))
            rest = trim_address(F.btrim(F.regexp_replace(rest, r"\s+", " "), F.lit(" -–—:")))
            tried.append(F.when(F.trim(F.lower(x)).startswith(start), let(rest, lambda r: F.when(F.length(r) >= 3, r))))
        return F.coalesce(*tried)

    lines = F.filter(F.transform(lines_of(F.coalesce(body, F.lit(""))), value), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.nullif(sender, F.lit("")), address, F.lit(""))


def safe_name(value: Column, default: str = "attachment") -> Column:
    clean = F.btrim(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.left(F.when(clean == "", default).otherwise(clean), F.lit(60))


def sanitize(text: Column) -> Column:
    """Without marks that fonts lack; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, fixed.UNDRAWABLE, " "), r"\s+", " "))
