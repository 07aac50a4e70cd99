"""Document fingerprints: MinHash signatures of 5-word shingles under universal hash functions, in vectorised numpy.

A fingerprint holds, for each of 128 hash functions a * x + b modulo 2**64, 16 bits of the least value over a text's shingles.
The share of equal places estimates the Jaccard similarity of two texts. ``similar_groups`` joins bands of signatures in
Spark and verifies the similarity on full sets; ``fingerprint_edits`` compares each document with an edited text and with the
next document, which meet in one pass over documents sorted within ranges of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .near_dup import BANDS, ROWS, near_duplicates
from .wordhash import Chunk, chunks, grams, mix

FUNCTIONS, WORDS = 128, 5
#: Text bytes of a range of ids; ranges at most, beyond which they grow (rows of a range are streamed, not gathered).
RANGE_BYTES, RANGES = 8 << 20, 10_000
_A = np.random.default_rng(99).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(98).integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
_SALT = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)).reshape(BANDS, ROWS)


def signatures(chunk: Chunk, n: int = WORDS) -> np.ndarray:
    """(rows, 128) 16-bit values; all zero for a text without words, a value no other text is given."""
    words = chunk.hashes(lower=True)
    shingles = grams(words, n)
    counts = np.diff(chunk.row_word)
    use = np.ones(len(words), bool)
    for back in range(1, n):
        at = chunk.row_word[1:] - back
        use[at[(at >= chunk.row_word[:-1]) & (counts >= n)]] = False
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        a, b = chunk.row_word[row : row + 2]
        use[a + 1 : b] = False
        shingles[a] = grams(np.append(words[a:b], np.uint64(b - a)), int(b - a) + 1)[0]
    out = np.zeros((len(counts), FUNCTIONS), np.uint16)
    some = np.flatnonzero(counts)
    if len(some):
        kept = shingles[use]
        first = np.concatenate(([0], np.cumsum(use)))[chunk.row_word[:-1][some]]
        for k in range(FUNCTIONS):
            least = np.minimum.reduceat(kept * _A[k] + _B[k], first)
            out[some, k] = np.maximum(mix(least) >> np.uint64(48), 1).astype(np.uint16)
    return out


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places; two texts without words are alike, one without words is like no other."""
    return float((a == b).mean())


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Bands of the signature of a non-empty set of shingle hashes."""
    least = np.array([(shingles * a + b).min() for a, b in zip(_A, _B, strict=True)])
    return mix((mix(least).reshape(BANDS, ROWS) * _SALT).sum(1, dtype=np.uint64)).view(np.int64)


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Groups of similar documents as in near_dup.near_duplicates, found by bands of these signatures."""
    return near_duplicates(docs, id_col=id_col, text_col=text_col, n=WORDS, percent=percent, bands=band_keys)


def _all_signatures(texts: list[str]) -> np.ndarray:
    return np.concatenate([signatures(c) for c in chunks(pa.array(texts, pa.large_string()))])


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of a text's code points replaced by as many first ones (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, extra, doc_id, text) in order; a row and the one after it in its range are a document and the next."""

    def flush(rows: list) -> pa.RecordBatch:
        """All but the last row are documents; the last one is only the next of the one before."""
        texts = [t for *_, t in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        signed = _all_signatures(texts + changed)
        own, new = signed[: len(texts)], signed[len(texts) :]
        keep = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
            [rows[k][2] for k in keep], [len(texts[k]) for k in keep], [hashlib.sha256(changed[k].encode()).hexdigest() for k in keep],
            [hexed(own[k]) for k in keep], [hexed(new[k]) for k in keep], [likeness(own[k], new[k]) for k in keep], [likeness(own[k], own[k + 1]) for k in keep],
        ), _SCHEMA, strict=True)], schema=_SCHEMA)

    waiting: list = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            waiting.append(row)
            size += len(row[3])
            if size > 1 << 19 and len(waiting) > 1:
                yield flush(waiting)
                waiting, size = waiting[-1:], len(row[3])
    if len(waiting) > 1:
        yield flush(waiting)


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is the one of the next smaller doc_id, after the least the largest.

    Null texts are empty. Rows without doc_id come last in that order; rows of equal doc_id are ordered by their text. A single
    row is its own next. No rows give no rows; other columns are ignored. Ids of more than 2**53 fall into ranges by their
    double, in which order is still exact.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, min(RANGES, -(-text_bytes(rows) // RANGE_BYTES)))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = sorted({float(c) for c in cuts or [0]})
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_place", outputCol="range").transform(rows.withColumn("_place", place)).withColumn("range", F.col("range").cast("int")).drop("_place")
    # the first of each range: also the next of the last document of the range above, or of the lowest range's last one
    heads = sorted(map(tuple, ranged.select("range", "doc_id").groupBy("range").agg(F.max("doc_id")).collect()), reverse=True)
    above = dict(zip([h for _, h in heads], [heads[-1][0], *[r for r, _ in heads[:-1]]], strict=True)) if heads else {}
    known = {h: r for h, r in above.items() if h is not None}
    target = F.try_element_at(F.create_map(*[x for h, r in known.items() for x in (F.lit(h), F.lit(r))]), F.col("doc_id")) if known and len(known) <= 64 else None
    if target is None:
        # at most RANGES rows of two numbers
        table = docs.sparkSession.createDataFrame(list(known.items()), "head long, target int")
        ranged = ranged.join(F.broadcast(table), ranged["doc_id"] == table["head"], "left").drop("head")
    else:
        ranged = ranged.withColumn("target", target)
    if None in above:
        ranged = ranged.withColumn("target", F.when(F.col("doc_id").isNull(), above[None]).otherwise(F.col("target")))
    copies = F.filter(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")), F.struct(F.col("target").alias("range"), F.lit(True).alias("extra"))), lambda x: x["range"].isNotNull())
    dealt = ranged.select(F.explode(copies).alias("c"), "doc_id", "text").select("c.range", "c.extra", "doc_id", "text")
    order = [F.col("range"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    return dealt.repartition(n, "range").sortWithinPartitions(*order).mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
