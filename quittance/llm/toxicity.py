"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes,
calibrated by cross-validation, with the nearest examples as evidence.

The examples are a bounded sample of labelled documents, copies included. Terms are lower-cased runs of letters and all of them
count: a term's weight is its inverse document frequency times a factor that grows with how much its presence tells about the
label (a likelihood ratio), from FLOOR for terms that tell nothing to 1. The index keeps, for each term and block of examples,
the largest weight in the block: the blocks of largest bound are scored first, then all others whose bound reaches the last
neighbour so far, which makes the search exact.
"""

from __future__ import annotations

import functools
import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_back
from .labelled import held_out, in_order, training_table

#: Labelled documents learned from at most; neighbours; examples in a block; blocks that are scored first; folds of calibration.
SAMPLE, NEIGHBOURS, BLOCK, FIRST, FOLDS = 4_000, 25, 64, 4, 4
#: Terms in more than a MANY-th of the examples have a row of weights; what rounding may add to a sum of products at most.
MANY, MARGIN = 32, 1e-5
#: Likelihood ratio at which a term has a quarter of its weight, and the least factor of a term.
HALF, FLOOR = 25.0, 0.001
THRESHOLD = 0.5
#: Examples and shared terms that a score shows as evidence.
SHOWN, SHOWN_TERMS = 3, 5
_TERM = re.compile(r"[^\W\d_]+")
Bag = tuple[np.ndarray, np.ndarray]


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


def _ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Likelihood ratio of a term's presence in a of na and b of nb examples."""

    def part(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / n / p), 0) + np.where(k < n, (n - k) * np.log(np.maximum(n - k, 1e-12) / n / np.maximum(1 - p, 1e-12)), 0)

    p = np.maximum((a + b) / (na + nb), 1e-12)
    return np.maximum(2 * (part(a, na, p) + part(b, nb, p)), 0)


def _weighted(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weighted sum of rows in this thread: a product of matrices would start BLAS threads, which wait busily beside other tasks."""
    return np.einsum("i,ij->j", weights, rows)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges low to high, one after another, and their sizes."""
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size), size


@dataclass
class BlockMaxIndex:
    """Postings of unit vectors by term and example. An entry is the part of a term's postings in one block, with the largest
    weight there; the bound of a block is the sum over a query's terms of their weight times that of the entry. Terms of many
    examples are also kept as whole rows of weights, which add up faster than postings. Sums over postings and rows only choose
    the finalists, with a margin for their rounding; cosines of finalists are summed again in double precision."""

    vectors: list[Bag]
    example: np.ndarray
    weight: np.ndarray
    first_entry: np.ndarray
    block: np.ndarray
    largest: np.ndarray
    first_posting: np.ndarray
    size: int

    @classmethod
    def build(cls, vectors: list[Bag], n_terms: int) -> BlockMaxIndex:
        """vectors: (ids of terms, weights) of each example."""
        vectors = [(np.asarray(ids, np.int32), np.asarray(w, np.float32)) for ids, w in vectors]
        term = np.concatenate([ids for ids, _ in vectors] or [np.zeros(0, np.int32)])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0, np.float32)])
        example = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(ids) for ids, _ in vectors])
        order = np.argsort(term, kind="stable")
        term, weight, example = term[order], weight[order], example[order]
        block = example // BLOCK
        start = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))[: len(term)])
        largest = np.maximum.reduceat(weight, start) if len(start) else weight
        return cls(vectors, example, weight, np.searchsorted(term[start], np.arange(n_terms + 1)), block[start], largest, np.append(start, len(term)), len(vectors))

    def __reduce__(self):
        """Pickled as its vectors; the lists are built again."""
        sizes = np.array([len(ids) for ids, _ in self.vectors], np.int32)
        ids, weights = (np.concatenate([v[k] for v in self.vectors] or [np.zeros(0, np.int32)]) for k in (0, 1))
        return _rebuilt, (sizes, ids, weights, len(self.first_entry) - 1)

    @functools.cached_property
    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each term, -1 without one; weights by row and example; the largest by row and block)."""
        held = self.first_posting[self.first_entry]
        many = np.flatnonzero(np.diff(held) * MANY > self.size)
        row = np.full(len(held) - 1, -1)
        row[many] = np.arange(len(many))
        weights, largest = np.zeros((len(many), self.size), np.float32), np.zeros((len(many), -(-self.size // BLOCK)), np.float32)
        for k, t in enumerate(many):
            weights[k, self.example[held[t] : held[t + 1]]] = self.weight[held[t] : held[t + 1]]
            largest[k, self.block[self.first_entry[t] : self.first_entry[t + 1]]] = self.largest[self.first_entry[t] : self.first_entry[t + 1]]
        return row, weights, largest

    @functools.cached_property
    def _query(self) -> np.ndarray:
        return np.zeros(len(self.first_entry) - 1)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, rounded to twelve decimals, least index on ties."""
        row, dense, largest = self.rows
        at = row[ids]
        in_rows, w = at[at >= 0], weights[at >= 0].astype(np.float32)
        rare, rest = ids[at < 0], weights[at < 0]
        entry, size = _ranges(self.first_entry[rare], self.first_entry[rare + 1])
        block = self.block[entry]
        bound = np.bincount(block, np.repeat(rest, size) * self.largest[entry], minlength=largest.shape[1]) + _weighted(w, largest[in_rows]) + MARGIN
        least = 0.0
        # where few blocks stand out, scoring those first can spare the others
        if np.count_nonzero(bound >= bound.max() / 2) <= len(bound) // 4:
            some = (np.sort(np.argsort(-bound, kind="stable")[:FIRST])[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            some = some[some < self.size]
            use = np.isin(block, some[::BLOCK] // BLOCK)
            posting, many = _ranges(self.first_posting[entry[use]], self.first_posting[entry[use] + 1])
            sums = self._sums(posting, np.repeat(np.repeat(rest, size)[use], many))[some] + _weighted(w, dense[in_rows[:, None], some])
            least = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0.0
        some = np.flatnonzero(np.repeat(bound >= least, BLOCK)[: self.size])
        if 4 * len(some) < self.size:
            use = (bound >= least)[block]
            posting, many = _ranges(self.first_posting[entry[use]], self.first_posting[entry[use] + 1])
            sums = self._sums(posting, np.repeat(np.repeat(rest, size)[use], many))[some] + _weighted(w, dense[in_rows[:, None], some])
        else:
            posting, many = _ranges(self.first_posting[self.first_entry[rare]], self.first_posting[self.first_entry[rare + 1]])
            sums = (self._sums(posting, np.repeat(rest, many)) + _weighted(w, dense[in_rows]))[some]
        least = np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) > k else 0.0
        # without a shared term a sum is exactly 0
        found = some[(sums >= least - MARGIN) & (sums > 0)]
        if not len(found):
            return []
        query = self._query
        query[ids] = weights
        parts = [self.vectors[j] for j in found.tolist()]
        products = query[np.concatenate([x for x, _ in parts])] * np.concatenate([x for _, x in parts])
        query[ids] = 0
        scores = np.round(np.add.reduceat(products, np.cumsum([0, *[len(x) for x, _ in parts[:-1]]])), 12)
        order = np.lexsort((found, -scores))[:k]
        return [(s, j) for s, j in zip(scores[order].tolist(), found[order].tolist(), strict=True) if s > 0]

    def _sums(self, posting: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Products summed by example, over some postings."""
        return np.bincount(self.example[posting], self.weight[posting] * weights, minlength=self.size)


def _rebuilt(sizes: np.ndarray, ids: np.ndarray, weights: np.ndarray, n_terms: int) -> BlockMaxIndex:
    ends = np.cumsum(sizes)[:-1]
    return BlockMaxIndex.build(list(zip(np.split(ids, ends), np.split(weights, ends), strict=True)) if len(sizes) else [], n_terms)


def _vote(near: list[tuple[float, int]], labels: np.ndarray, share: float) -> float:
    """Votes weigh 1 / (distance + 0.05), and the label's share stands in for one distant vote."""
    weights = [1 / (1.05 - s) for s, _ in near]
    return float((sum(w * labels[j] for w, (_, j) in zip(weights, near, strict=True)) + share) / (sum(weights) + 1))


def _unit(bag: Bag, weight: np.ndarray) -> Bag:
    ids, counts = bag
    w = (1 + np.log(counts)) * weight[ids]
    norm = math.sqrt(float((w * w).sum()))
    return (ids, w / norm) if norm > 0 else (ids[:0], w[:0])


def _learned(bags: list[Bag], y: np.ndarray, n_terms: int) -> tuple[np.ndarray, BlockMaxIndex, float]:
    """(weight of each term, index, smoothed share of label 1)."""
    n, n1 = len(y), int(y.sum())
    df, df1 = np.zeros(n_terms), np.zeros(n_terms)
    for (ids, _), label in zip(bags, y, strict=True):
        df[ids] += 1
        df1[ids] += label
    ratio = _ratio(df1, df - df1, n1, n - n1) if 0 < n1 < n else np.zeros(n_terms)
    weight = np.log((n + 1) / (df + 0.5)) * (FLOOR + (1 - FLOOR) * (ratio / (ratio + HALF)) ** 2)
    return weight, BlockMaxIndex.build([_unit(b, weight) for b in bags], n_terms), (n1 + 0.5) / (n + 1)


def _logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _calibration(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds of votes that make them probabilities: logistic regression by Newton's method, with
    targets a little inside 0 and 1. (1, 0) if it has no rising solution."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    x, target = _logit(raw), np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - target) * x).sum() + 1e-3 * (theta[0] - 1), (p - target).sum()])
        hessian = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 and np.isfinite(theta).all() else (1.0, 0.0)


@dataclass
class Model:
    vocabulary: dict[str, int]
    weight: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    share: float
    slope: float
    offset: float

    def vector(self, text: str | None) -> Bag:
        """Term ids, rising, and weights of unit length; empty for a text without a term of any example."""
        found, known = terms(text or ""), self.vocabulary.get
        ids, counts = np.array([known(t, -1) for t in found], np.int64), np.array(list(found.values()), np.float64)
        order = np.argsort(ids)[np.count_nonzero(ids < 0) :]
        return _unit((ids[order], counts[order]), self.weight)

    def score(self, text: str | None) -> tuple[float, Bag, list[tuple[float, int]]]:
        """(score, vector, neighbours)."""
        vector = self.vector(text)
        if not len(vector[0]):
            return self.share, vector, []
        near = self.index.nearest(*vector, NEIGHBOURS)
        return float(1 / (1 + np.exp(-(self.slope * _logit(_vote(near, self.labels, self.share)) + self.offset)))), vector, near

    def evidence(self, vector: Bag, near: list[tuple[float, int]], names: list[str]) -> list[dict]:
        """Of the nearest examples: id, label, cosine and the shared terms of the largest weight."""
        out = []
        for s, j in near[:SHOWN]:
            shared = np.flatnonzero(np.isin(vector[0], self.index.vectors[j][0], assume_unique=True))
            top = shared[np.argsort(-vector[1][shared] * self.weight[vector[0][shared]], kind="stable")[:SHOWN_TERMS]]
            out.append({"doc_id": int(self.ids[j]), "label": int(self.labels[j]), "cosine": s, "terms": [names[t] for t in vector[0][top]]})
        return out


def fit(rows: Iterable[tuple[int, str, int]]) -> Model:
    """Of (id, text, label). Texts are dropped at once; the distinct terms of each stay, as numbers. Votes of each fold by the
    terms and examples of the others give the calibration."""
    number: dict[str, int] = {}
    bags, labels, ids = [], [], []
    for i, text, y in rows:
        found = sorted((number.setdefault(t, len(number)), n) for t, n in terms(text).items())
        bags.append((np.array([t for t, _ in found], np.int32), np.array([n for _, n in found], np.float32)))
        labels.append(y)
        ids.append(i)
    y = np.array(labels, float)
    raw, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        weight, index, share = _learned([bags[k] for k in rest], y[rest], len(number))
        for k in np.flatnonzero(fold == f):
            vector = _unit(bags[k], weight)
            raw[k] = _vote(index.nearest(*vector, NEIGHBOURS), y[rest], share) if len(vector[0]) else share
        del index
    weight, index, share = _learned(bags, y, len(number))
    return Model(number, weight, index, np.array(ids, np.int64), y, share, *_calibration(raw, y))


def _scored(shared, evidence: bool):
    """The text column of a batch, which is its last one, to scores, and the evidence for them if it is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        names, kept = list(model.vocabulary), {}
        shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64()), ("terms", pa.list_(pa.string()))]))
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1):
                text = t.as_py() or ""
                key = hashlib.blake2b(text.encode(), digest_size=16).digest()
                if key not in kept:
                    if len(kept) > 4_000:
                        kept.clear()
                    score, vector, near = model.score(text)
                    kept[key] = score, model.evidence(vector, near, names) if evidence else None
                out.append(kept[key])
            columns = [*batch.columns[:-1], pa.array([s for s, _ in out], pa.float64())]
            if evidence:
                columns.append(pa.array([e for _, e in out], shape))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *["score", "evidence"][: 1 + evidence]])

    return run


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = fit(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, 5)], pa.binary())], ["model"])


def _fitted(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str):
    """The model, pickled, as a broadcast. It is fitted in one task over at most SAMPLE rows, so that their texts and the work on
    them don't take the driver's memory."""
    rows = training_table(docs, labels, label, SAMPLE, id_col=id_col, text_col=text_col).repartition(1).sortWithinPartitions(*in_order())
    found = rows.mapInArrow(_learn, "model binary").first()
    return docs.sparkSession.sparkContext.broadcast(bytes(found["model"]) if found else pickle.dumps(fit([]), 5))


_models: dict[bytes, Model] = {}


def _forget() -> None:
    """Gives a worker's memory back before it serves another stage; its next task of this one builds the model again."""
    _models.clear()
    memory_back()


def _model(pickled: bytes) -> Model:
    """The model, kept for the next task of this worker."""
    key = hashlib.blake2b(pickled, digest_size=16).digest()
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(pickled)
    return _models[key]


def score_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, a calibrated probability of label 1), evidence (the nearest
    examples: doc_id, label, cosine and the shared terms that weigh most), predicted (1 if score >= threshold).

    Learns from at most SAMPLE labelled rows that aren't held out. Texts without a term of any example (null, empty and blank
    ones too) score the smoothed share of label 1 and have no evidence. Equal texts score alike; ties among examples go to the
    one learned first. Very long texts are read whole. Without labels of both kinds every score is near the smoothed share, 0.5
    without any; of several labels of an id the largest counts. Repeated rows give repeated results, no rows none; other columns
    are ignored, whatever their names.
    """
    shared = _fitted(docs, labels, label, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_scored(shared, True), "doc_id long, held_out boolean, score double, evidence array<struct<doc_id:bigint,label:int,cosine:double,terms:array<string>>>")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more; rows and columns that stay are as they were, whatever their names.

    Rows without doc_id are judged like others. Null and empty texts score the share of label 1, so they stay unless most
    examples are toxic. Repeated rows go or stay together; an empty table stays empty.
    """
    shared = _fitted(docs, labels, label, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = None

        def texts():
            nonlocal batch
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"])

        for scored in _scored(shared, False)(texts()):
            clean = [s < threshold for s in scored.column("score").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))
        batch = scored = None
        _forget()

    return docs.mapInArrow(run, docs.schema)
