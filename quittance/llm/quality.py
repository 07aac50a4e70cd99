"""Quality scores by supervised subword embeddings: hashed vectors of words and character n-grams, averaged over a whole
document, and a softmax over two labels; learned by stochastic gradient descent in numpy on a bounded sample.

The softmax of an average is linear in the vectors, so scoring needs one number per hash bucket: the executors get a table
of 2**BITS whole numbers, and a document's score is the mean of the entries of its words and n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .wordhash import BASE, INVERSE, _BYTES, Chunk, chunks, mix, powers

#: Labelled documents learned from at most; buckets (as bits), vector size, lengths of n-grams of code points.
SAMPLE, BITS, DIMS, GRAMS = 4_000, 17, 12, (3, 4)
EPOCHS, RATE, DECAY, SEED = 6, 0.5, 1e-5, 11
THRESHOLD = 0.3
#: Steps of a bucket's log odds to one.
UNIT = 1 << 24


def _inside(first: np.ndarray, n: int) -> np.ndarray:
    """For n places in rows that begin at first (its last entry is the end), the place within the row."""
    return np.arange(n) - np.repeat(first[:-1], np.diff(first))


def features(chunk: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of features: (bucket of each feature of a chunk in order, first feature of each row and the end). A feature
    depends on its own row alone, whatever rows stand beside it."""
    shift = np.uint64(64 - BITS)
    words = chunk.hashes()
    out = [(mix(words ^ np.uint64(1)) >> shift, chunk.row_word)]
    if len(words):
        # a word that was among the few before it makes one more kind of n-gram: repetition
        again, at = np.full(len(words), 3, np.uint64), _inside(chunk.row_word, len(words))
        for back in (3, 2, 1):
            again[back:][(words[back:] == words[:-back]) & (at[back:] >= back)] = back - 1
        out.append((mix(again ^ np.uint64(77)) >> shift, chunk.row_word))
    n = len(chunk.data)
    x = _BYTES[chunk.data] * powers(BASE, n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=prefix[1:])
    inverse = powers(INVERSE, max(n, 1))
    # an n-gram is of code points: from the first byte of one to the first byte of the one n further on, in its row
    begin = np.flatnonzero(chunk.data & 0xC0 != 0x80)
    row = np.searchsorted(begin, chunk.row_byte)
    left = np.repeat(np.diff(row), np.diff(row)) - _inside(row, len(begin))
    begin_and_end = np.append(begin, n)
    for size in GRAMS:
        use = np.flatnonzero(left >= size)
        a, b = begin[use], begin_and_end[use + size]
        out.append((mix((prefix[b] - prefix[a]) * inverse[a] ^ np.uint64(size)) >> shift, np.searchsorted(use, row)))
    return out


@dataclass
class Model:
    """table: what each bucket adds to the log odds of label 1, in units of 2**-24, so that sums are exact and a score doesn't
    depend on what was added before; bias: the log odds without features."""

    table: np.ndarray
    bias: float

    def score(self, chunk: Chunk) -> np.ndarray:
        rows = chunk.last - chunk.first
        total, count = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for buckets, at in features(chunk):
            sums = np.zeros(len(buckets) + 1, np.int64)
            np.cumsum(self.table[buckets], out=sums[1:])
            total += sums[at[1:]] - sums[at[:-1]]
            count += np.diff(at)
        return np.array([1 / (1 + math.exp(-(self.bias + t / UNIT / max(n, 1)))) for t, n in zip(total.tolist(), count.tolist(), strict=True)])


def fit(rows: Iterable[tuple[str, int]]) -> Model:
    """Of (text, label). One label only gives the smoothed share of it for every text, no rows 0.5. Memory: the distinct
    buckets of each document of the sample."""
    docs = []
    for text, y in rows:
        for chunk in chunks(pa.array([text])):
            ids, n = np.unique(np.concatenate([b for b, _ in features(chunk)]), return_counts=True)
            if len(ids):
                docs.append((ids.astype(np.int64), (n / n.sum()).astype(np.float32), y))
    share = (sum(y for *_, y in docs) + 0.5) / (len(docs) + 1)
    bias = float(np.log(share / (1 - share)))
    if len({y for *_, y in docs}) < 2:
        return Model(np.zeros(1 << BITS, np.int64), bias)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS)).astype(np.float32)
    weights = rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32)
    offset = np.array([0.0, bias], np.float32)
    total = EPOCHS * len(docs)
    for step, k in enumerate(np.concatenate([rng.permutation(len(docs)) for _ in range(EPOCHS)])):
        ids, share_of, y = docs[k]
        rate = RATE * (1 - step / total)
        hidden = share_of @ vectors[ids]
        z = hidden @ weights + offset
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        # the average's gradient is thin when a text has many features, so it is scaled up to the few that tell
        vectors[ids] -= (rate * 40) * share_of[:, None] * (weights @ p)
        weights -= rate * (np.outer(hidden, p) + DECAY * weights)
        offset -= rate * 0.1 * p
    return Model(np.rint((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64) * UNIT).astype(np.int64), float(offset[1] - offset[0]))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                rows = slice(chunk.first, chunk.last)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array(model.score(chunk))], ["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (probability of label 1), predicted (1 if score >= threshold).

    Learns from at most SAMPLE labelled rows that aren't held out. Null and empty texts have no features and score the share of
    label 1 learned. A score is a function of the text and the model: equal texts, repeated rows and rows without doc_id score
    alike to the last bit, in whatever batch they stand. Very long texts are read whole, in memory of their own size. Without
    labels every score is 0.5; of several labels of an id the largest counts; no rows give no rows; other columns are ignored,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit((text, y) for _, text, y in training_rows(docs, labels, label, SAMPLE, id_col=id_col, text_col=text_col)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
