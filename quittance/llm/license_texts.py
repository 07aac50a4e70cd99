"""License texts: whole texts against notices and full licence texts by Dice over word bigrams, in any window of words.

Text and template are lower-cased (A-Z) and everything but a-z and 0-9 becomes a space, line feeds too. A window is any run of
words of the text, up to the whole; its set of bigrams and the template's give 2 * shared / (sizes added). The best window is
found exactly: one that reaches a threshold t against a bigrams shares at least a * t / (2 - t) of them, so a text without so
many has none, and has at most a * (2 - t) / t itself. A shared bigram just before a window never lowers its coefficient, so
windows start only where a run of shared ones starts. Row by row, no exchange.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import let
from .common import ascii_lower
from .license_scan import NOTICES, THRESHOLD, bigrams, bounds


def templates() -> list[tuple[str, str]]:
    """(identifier, text) of all notices and of the full texts in licenses/."""
    full = sorted((Path(__file__).resolve().parent / "licenses").glob("*.txt"))
    return sorted([*NOTICES.items(), *((p.stem, p.read_text(encoding="utf-8")) for p in full)])


def _within(grams: list[str]) -> str:
    """Bigrams are of a-z, 0-9 and one space, so they need no escapes."""
    return "(" + ", ".join(f"'{g}'" for g in grams) + ")"


def _linked(grams: Column) -> Column:
    """array<struct<gram, before>>: each bigram with the position of its last earlier occurrence, 0 without one."""
    placed = F.array_sort(F.transform(grams, lambda g, k: F.struct(g.alias("gram"), (k + 1).alias("at"))))
    before = lambda s: F.zip_with(s, F.slice(F.concat(F.array(F.struct(F.lit("").alias("gram"), F.lit(0).alias("at"))), s), F.lit(1), F.size(s)), lambda x, y: F.struct(x["at"].alias("at"), x["gram"].alias("gram"), F.when(x["gram"] == y["gram"], y["at"]).otherwise(0).alias("before")))
    return let(placed, lambda s: F.array_sort(before(s)))


def _best(linked: Column, grams: Column, size: Column, threshold: float) -> Column:
    """The highest coefficient of a window of the linked bigrams against a template's, of which grams occur in the text."""
    need, most = F.ceil(size * threshold / (2 - threshold) - 1e-9), F.floor(size * (2 - threshold) / threshold + 1e-9).cast("int")

    def from_start(rows, start):
        fresh = F.slice(F.filter(F.slice(rows, start, F.size(rows)), lambda x: x["before"] < start), F.lit(1), most)
        step = lambda acc, x: F.struct((acc["b"] + 1).alias("b"), (acc["s"] + x["y"]).alias("s"), F.greatest(acc["d"], 2.0 * (acc["s"] + x["y"]) / (acc["b"] + 1 + size)).alias("d"))
        none = F.struct(F.lit(0).alias("b"), F.lit(0).alias("s"), F.lit(0.0).alias("d"))
        return let(fresh, lambda f: F.when(F.size(F.filter(f, lambda x: x["y"] == 1)) >= need, F.aggregate(f, none, step, lambda acc: acc["d"])))

    def over(rows):
        starts = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: (rows[i - 1]["y"] == 1) & ((i == 1) | (rows[F.greatest(i - 2, F.lit(0))]["y"] == 0)))
        return F.array_max(F.transform(starts, lambda i: from_start(rows, i)))

    marked = F.transform(linked, lambda x: F.struct(x["before"].alias("before"), F.array_contains(grams, x["gram"]).cast("int").alias("y")))
    return let(marked, over)


def scan_license_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, license (identifier of the template with the best window, least on ties, else null),
    dice (its coefficient, else null), licenses (identifiers of all templates that reach the threshold, sorted, joined by commas).

    A null or empty text has no license. Repeated rows give repeated results, no rows none. Templates without a bigram never
    match; other columns are ignored.
    """
    kept = [(name, g) for name, text in sorted(templates() if known is None else known) if (g := bigrams(text))]
    if not kept:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), F.lit("").alias("licenses"))
    words = F.filter(F.split(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("_words"))
    pairs = F.zip_with(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0))), F.slice("_words", F.lit(2), F.size("_words")), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.select("doc_id", pairs.alias("_grams"))
    every = sorted({g for _, grams in kept for g in grams})
    rows = rows.select("doc_id", "_grams", F.expr(f"array_distinct(filter(_grams, g -> g in {_within(every)}))").alias("_known"))
    least = [math.ceil(bounds(len(grams), threshold)[0] - 1e-9) for _, grams in kept]
    # per template that enough of the text's bigrams are of: its place, size and those bigrams
    tried = ", ".join(f"named_struct('k', {k}, 'size', {len(g)}, 'grams', filter(_known, g -> g in {_within(g)}))" for k, (_, g) in enumerate(kept))
    enough = F.expr(f"case when size(_known) >= {min(least)} then filter(array({tried}), (c, k) -> size(c.grams) >= array({', '.join(map(str, least))})[k]) end")
    rows = rows.select("doc_id", "_grams", enough.alias("_tried"))
    some = F.size(F.coalesce("_tried", F.array())) > 0
    rows = rows.select("doc_id", "_tried", F.when(some, _linked(F.col("_grams"))).alias("_linked"))
    scored = F.transform("_tried", lambda c: F.struct(_best(F.col("_linked"), c["grams"], c["size"], threshold).alias("dice"), (-c["k"]).alias("at")))
    rows = rows.select("doc_id", F.when(F.col("_linked").isNotNull(), F.filter(scored, lambda x: x["dice"] >= threshold)).alias("_hits"))
    names = F.array(*[F.lit(name) for name, _ in kept])
    top = F.array_max("_hits")
    found = F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda x: F.get(names, -x["at"])))), ",")
    return rows.select("doc_id", F.get(names, -top["at"]).alias("license"), top["dice"].alias("dice"), F.coalesce(found, F.lit("")).alias("licenses"))
