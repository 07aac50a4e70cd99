"""License scans: lines of a text against license notices by Dice coefficient over word bigrams, in DataFrame expressions.

A notice and a line are lower-cased (A-Z), everything but a-z and 0-9 becomes a space, and the sets of their word bigrams
are compared: 2 * shared / (sizes added). A line of b bigrams can reach a threshold t against a notice of a bigrams only
if b is between a * t / (2 - t) and a * (2 - t) / t, so other notices aren't looked at. Row by row, no exchange.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Identifiers and the notices by which licenses are commonly applied to a work.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8


def bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.translate({i: i + 32 for i in range(65, 91)})).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[float, float]:
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, license (identifier of the best notice over all lines, least on ties, else null),
    dice (its coefficient, else null), license_lines (lines that reach the threshold).

    A null or empty text has no license and 0 lines. Repeated rows give repeated results, no rows none. Notices without a
    bigram never match; other columns are ignored.
    """
    known = {k: v for k in sorted(notices or NOTICES) if (v := bigrams((notices or NOTICES)[k]))}
    lines = F.split(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9\n]+", " "), "\n")
    words = F.transform(lines, lambda x: F.split(F.trim(x), " "))
    low = int(min((bounds(len(v), threshold)[0] for v in known.values()), default=0))
    words = F.filter(words, lambda w: F.size(w) > low)
    pairs = F.transform(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))

    def best(found):
        """The best notice for one line: struct(dice, -position), null if none reaches the threshold."""
        tried = []
        for k, v in enumerate(known.values()):
            a, b = bounds(len(v), threshold)
            dice = 2.0 * F.size(F.array_intersect(found, F.array(*map(F.lit, v)))) / (F.size(found) + len(v))
            tried.append(F.when(F.size(found).between(a - 1e-9, b + 1e-9), F.struct(dice.alias("dice"), F.lit(-k).alias("at"))))
        top = F.greatest(*tried) if len(tried) > 1 else tried[0]
        return top

    if not known:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), F.lit(0).cast("long").alias("license_lines"))
    hits = docs.select(F.col(id_col).alias("doc_id"), F.filter(F.transform(pairs, best), lambda x: x["dice"] >= threshold).alias("_hits"))
    top, some = F.array_max("_hits"), F.size("_hits") > 0
    return hits.select("doc_id", F.when(some, F.element_at(F.array(*map(F.lit, known)), 1 - top["at"])).alias("license"), F.when(some, top["dice"]).alias("dice"), F.size("_hits").cast("long").alias("license_lines"))


def oracle() -> str:
    rows = ",\n    ".join(f"('{k}', [{', '.join(chr(39) + x + chr(39) for x in bigrams(v))}])" for k, v in NOTICES.items())
    return rf"""
with notices(license, grams) as (values
    {rows}),
lines as (
  select doc_id, n, unnest(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\n]+', ' ', 'g'), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k
  from (select doc_id, text, row_number() over () as n from documents)),
words as (select doc_id, n, k, string_split(trim(line), ' ') as w from lines),
grams as (
  select doc_id, n, k, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) as g
  from words where len(w) >= 2),
scored as (
  select n, k, license, 2.0::double * len(list_intersect(g, grams)) / (len(g) + len(grams)) as dice
  from grams join notices on len(g) between len(grams) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 and len(grams) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9),
hits as (select * from scored where dice >= {THRESHOLD}),
found as (
  select n, min_by(license, struct_pack(d := -dice, l := license)) as license, max(dice) as dice, count(distinct k) as license_lines
  from hits group by n)
select d.doc_id, f.license, f.dice, cast(coalesce(f.license_lines, 0) as bigint) as license_lines
from (select doc_id, row_number() over () as n from documents) d left join found f using (n)
"""
