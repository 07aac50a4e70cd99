"""Nearest vectors by a permutation index: pivot inverted files, footrule ranking, exact reranking.

A vector is represented by its nearest pivots in order. The index is cut into blocks of vectors; in a block each pivot has a
list of the vectors that have it among their nearest, with its place there. A query walks the lists of its own nearest pivots
and adds up what each shared pivot takes off the footrule distance between the two orders; the best share of the block is
scored exactly. Equal vectors are one entry of the index, so a vector that many rows hold costs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Distinct vectors that pivots are chosen from (the least by hash), pivots, places of a representation, share of a block that
#: is scored and least number of it, vectors of a block, queries that meet a block at once.
SAMPLE, PIVOTS, PLACES, SHARE, LEAST, BLOCK, QUERIES = 4096, 256, 64, 0.15, 512, 4096, 4096
#: Share of the most that two orders can agree, from which entries are scored whatever their number.
ALIKE = 0.7


def widened(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """One more component, which makes all entries as long as the longest and leaves inner products with queries (longest
    None) as they are: the largest inner product is then the smallest angle."""
    more = np.zeros(len(vectors)) if longest is None else np.sqrt(np.maximum(longest**2 - (vectors * vectors).sum(1), 0))
    return np.column_stack((vectors, more))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Far from each other: the first, then always the one whose most similar pivot is the least similar. Copies and near
    copies of one vector, however many the sample holds, give one pivot."""
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    kept, nearest = [0], unit @ unit[0]
    while len(kept) < min(PIVOTS, len(unit)):
        kept.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[kept[-1]])
    return unit[kept]


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, least pivot on ties."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :PLACES].astype(np.int16)


class InvertedFiles:
    """For each pivot, the entries that have it among their nearest, and its place there."""

    def __init__(self, order: np.ndarray):
        self.size, self.depth = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.entry, self.place = (by // max(self.depth, 1)).astype(np.int64), (by % max(self.depth, 1)).astype(np.int32)
        self.at = np.searchsorted(flat[by], np.arange(PIVOTS + 1))

    def nearest(self, order: np.ndarray, n: int) -> np.ndarray:
        """The n entries of least footrule distance to an order of pivots; a missing pivot stands behind the last place, so
        the distance is a constant less twice the sum of depth - max(places) over shared pivots."""
        gain = np.zeros(self.size, np.int32)
        for place, pivot in enumerate(order):
            a, b = self.at[pivot], self.at[pivot + 1]
            gain[self.entry[a:b]] += self.depth - np.maximum(self.place[a:b], place)
        if n >= self.size:
            return np.arange(self.size)
        # among orders almost the query's own (near copies of one vector) the footrule can't choose: all of them are scored
        n = max(n, int((gain >= ALIKE * self.depth * (self.depth + 1) / 2).sum()))
        return np.argsort(-gain, kind="stable")[:n]


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _represent(pivots: np.ndarray, longest: float | None):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("embedding"), pivots.shape[1] - 1).astype(np.float64)
                order = places(widened(vectors, longest), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))], [*batch.schema.names, "places"])

    return run


def _search(width: int, k: int):
    schema = pa.schema([("q", pa.int64()), ("class_id", pa.int64()), ("score", pa.float64())])

    def run(key, queries, entries):
        if not queries.num_rows or not entries.num_rows:
            return schema.empty_table()
        entries = entries.sort_by("class_id")
        ids = entries["class_id"].to_numpy()
        vectors = _matrix(entries["embedding"], width).astype(np.float64)
        files = InvertedFiles(_matrix(entries["places"], len(entries["places"][0])))
        n = max(LEAST, int(np.ceil(SHARE * len(ids))))
        out = ([], [], [])
        for q, x, order in zip(queries["class_id"].to_numpy(), _matrix(queries["embedding"], width).astype(np.float64), _matrix(queries["places"], files.depth), strict=True):
            found = np.sort(files.nearest(order, n))
            score = (vectors[found] * x).sum(1)
            best = np.argsort(-score, kind="stable")[: k + 1]
            for o, v in zip(out, (np.full(len(best), q), ids[found[best]], score[best]), strict=True):
                o.append(v)
        return pa.table([pa.array(np.concatenate(o)) for o in out], schema=schema)

    return run


def nearest_neighbours(vectors: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query, a row whose id is divisible by ``every``: its k nearest of all other rows by inner product in double
    precision, nearest first, ties to the smaller id: query_id, rank, vec_id, score.

    Vectors that are null, zero, hold null or non-finite components, have no id or not the commonest length take no part. Of
    several rows with one id the least vector counts. Fewer than k candidates give as many rows; no rows give none; other
    columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = scratch.write(rows.where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "rows")
    width = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    width = int(width["n"])
    rows = rows.where(F.size("embedding") == width)
    # of equal vectors the k + 1 least ids can be among anyone's k nearest
    least = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    classes = scratch.write(few.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    sample = classes.orderBy(F.xxhash64("embedding"), "class_id").limit(SAMPLE).select("embedding").collect()
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = float(classes.agg(F.max(square)).first()[0]) ** 0.5
    pivots = choose_pivots(widened(np.array([r["embedding"] for r in sample], np.float64), longest))
    represented = f"class_id long, embedding {dict(classes.dtypes)['embedding']}, places array<short>"
    index = scratch.write(classes.select("class_id", "embedding").mapInArrow(_represent(pivots, longest), represented), "index")
    queries = scratch.write(rows.where(F.col("vec_id") % every == 0).join(classes.select("embedding", "class_id"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("q")), "queries")
    asked = classes.select("class_id", "embedding").join(queries.select(F.col("q").alias("class_id")).distinct(), "class_id", "left_semi")
    asked = scratch.write(asked.mapInArrow(_represent(pivots, None), represented), "asked")

    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((index, BLOCK), (asked, QUERIES)))
    place = lambda n, seed: F.pmod(F.xxhash64("class_id", F.lit(seed)), F.lit(n)).cast("int")
    everyone = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = asked.select("class_id", "embedding", "places", place(parts, 2).alias("part"), everyone(blocks).alias("block"))
    held = index.select("class_id", "embedding", "places", place(blocks, 1).alias("block"), everyone(parts).alias("part"))
    found = met.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(_search(width, k), "q long, class_id long, score double")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    members = found.join(classes.select("class_id", "ids"), "class_id").select("q", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    members = scratch.write(members.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "found")
    # a query's own row is left out; it can only be one of the k + 1
    answers = queries.join(members, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
