"""MinHash near-duplicate groups: one-permutation hashing with optimal densification, banded buckets, star edges.

1. Every text gives its set of 5-word shingle hashes, one permutation of which fills 128 bins; an empty bin borrows from
   the first filled one in its own random order of bins (optimal densification).
2. Equal sets become one class, represented by its least doc_id: copies cost one row, however many there are.
3. 32 bands of 4 bins make buckets of classes. Each bucket gives star edges to its least class, a large one also to the least
   class of random parts; edges are verified on the full sets and joined to components.
4. Buckets that still hold several components would lose links between leaves. Small ones give their open pairs; those of
   large ones meet by exact prefix filtering (two sets this similar share one of their rarest shingles) instead. All are
   verified, and components are taken again.

A pair at similarity 0.75 shares no band with probability 5e-6; that is the only approximation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, giving_back, unnamed
from .components import connected_components
from .wordhash import chunks, mix, shingle_sets

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Classes in a random part of a large bucket, ways to make parts; a bucket of more classes than SMALL_BUCKET that still holds
#: several components is resolved by prefix filtering.
PART, ROUNDS, SMALL_BUCKET = 8, 2, 64
#: Longs of the bit set that bounds how much two sets share.
WORDS = 64
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_ORDER = np.stack([np.concatenate(([i], r[r != i])) for i in range(BINS) for r in [np.random.default_rng(7000 + i).permutation(BINS)]])
_LANES = np.arange(BINS)
_SALT = mix(np.arange(1, BINS + 1, dtype=np.uint64)).reshape(BANDS, ROWS)
_ONE, _TWO = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 bins of a non-empty sorted set of hashes, densified."""
    at = np.searchsorted(shingles, _EDGES)
    filled = np.diff(np.append(at, len(shingles))) > 0
    source = _LANES if filled.all() else _ORDER[_LANES, filled[_ORDER].argmax(1)]
    return shingles[at[source]]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    return mix((mix(signature(shingles)).reshape(BANDS, ROWS) * _SALT).sum(1, dtype=np.uint64)).view(np.int64)


def _signatures(n: int, band_keys: Callable[[np.ndarray], np.ndarray]):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                rows = chunk.last - chunk.first
                size, keys, bands = np.zeros(rows, np.int64), np.zeros((2, rows), np.int64), np.zeros((rows, BANDS), np.int64)
                for row, found in shingle_sets(chunk, n):
                    if len(found):
                        k = row - chunk.first
                        size[k], bands[k] = len(found), band_keys(found)
                        keys[0, k], keys[1, k] = (mix(found ^ x).sum(dtype=np.uint64).view(np.int64) for x in (_ONE, _TWO))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, rows), pa.array(size), pa.array(keys[0]), pa.array(keys[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
                ], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


def _sets(n: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = [s.view(np.int64) for _, s in shingle_sets(chunk, n)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, len(found)),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found))),
                ], ["node", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (u, v), those whose full shingle sets are similar enough. Merge joins: neither side has a bounded size."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")).hint("merge") for x in "uv")
    both = pairs.join(a, "u").join(b, "v")
    shared = both.select("u", "v", (F.size("s_u") + F.size("s_v")).cast("long").alias("total"), F.size(F.array_intersect("s_u", "s_v")).cast("long").alias("shared"))
    return shared.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("u", "v").distinct()


def _by_prefix(members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (u, v) of different components among members (node, component) that share one of the first shingles of their sets,
    in an order that all sets keep: those of one set first, then those of two, then all others. All pairs of the wanted
    similarity are among them; the first are size - ceil(size * percent / 100) + 1 of a set."""
    held = sets.join(members.hint("merge"), "node")
    often = held.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n <= 2")
    rare = often.select("s", "n", F.explode(F.array_distinct(F.array("a", "b"))).alias("node")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("rare"))
    alone = lambda n: F.transform(F.filter(F.coalesce("rare", F.array().cast("array<struct<n:bigint,s:bigint>>")), lambda x: x["n"] == n), lambda x: x["s"])
    ranked = held.join(rare, "node", "left").select("node", "component", F.size("shingles").alias("size"), "shingles", alone(1).alias("one"), alone(2).alias("two"))
    # shingles of one set only can't be shared; they fill the prefix first
    ranked = ranked.withColumn("r", F.concat("two", F.array_except(F.array_except("shingles", "one"), "two")))
    keep = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - F.size("one")
    ranked = ranked.withColumn("keep", keep.cast("int")).where("keep > 0").withColumn("p", F.expr("slice(r, 1, greatest(keep, 0))"))
    bits = [F.expr(f"aggregate(r, 0L, (a, x) -> if(pmod(x, {WORDS}) = {k}, a | shiftleft(1L, cast(pmod(shiftrightunsigned(x, 8), 64) as int)), a))").alias(f"b{k}") for k in range(WORDS)]
    prefix = ranked.select("node", "component", "size", F.size("r").alias("common"), "p", *bits)
    prefix = prefix.withColumn("crowd", F.col("common") - sum((F.bit_count(f"b{k}") for k in range(WORDS)), F.lit(0)))
    names = ["node", "component", "size", "common", "crowd", *[f"b{k}" for k in range(WORDS)]]
    prefix = scratch.write(prefix.select(*names, F.explode("p").alias("s")), "open-prefix")
    # of two sets of different components one isn't of the component that most sets of a shingle are of
    most = prefix.groupBy("s", "component").agg(F.count("*").alias("n")).groupBy("s").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).where("n > most.n").select("s", "most.component")
    fewer = prefix.join(most.withColumnRenamed("component", "most"), "s").where("component <> most")
    a, b = (df.select("s", *[F.col(c).alias(f"{c}_{x}") for c in names]) for df, x in ((fewer, "u"), (prefix, "v")))
    # two sets share at most as many members as either has in common with any other, and as many as bits that both have set and
    # the lesser number of members that found theirs taken
    both = " + ".join(f"bit_count(b{k}_u & b{k}_v)" for k in range(WORDS))
    enough = lambda most: f"100 * {most} >= {percent} * (size_u + size_v - {most})"
    fits = f"component_u <> component_v and {enough('least(common_u, common_v)')} and {enough(f'({both} + least(crowd_u, crowd_v))')}"
    return a.join(b, "s").where(fits).select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v): in each bucket, every class with the least one; in buckets of more than PART, also every class with the
    least one of its random part, for each of ROUNDS ways to make parts. As many pairs as members at most, times ROUNDS + 1."""
    parts = [members.withColumn("part", F.lit(0).cast("long"))]
    for k in range(ROUNDS):
        salt = F.pmod(F.xxhash64("node", F.lit(k)), F.ceil(F.col("n") / PART))
        parts.append(members.where(F.col("n") > PART).withColumn("part", (k + 1) * F.lit(1 << 40) + salt))
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    least = every.groupBy("band", "key", "part").agg(F.min(F.struct("node", "n_shingles")).alias("c"))
    met = every.join(least, ["band", "key", "part"]).where("node <> c.node").where(F.least("n_shingles", "c.n_shingles") * 100 >= F.greatest("n_shingles", "c.n_shingles") * percent)
    return met.select(F.col("c.node").alias("u"), F.col("node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, bands: Callable[[np.ndarray], np.ndarray] = band_keys) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable over links of similarity percent /
    100 or more), kept (doc_id = component_id).

    Words are cut at ASCII white space after lower-casing A-Z. Texts without words (null, empty, blank) are in a component
    of their own. Rows that share a doc_id are one node, which links what any of them links. A row without doc_id links nothing:
    component_id null, kept true. Very long texts are read whole; of equal sets the least doc_id stands for all. Repeated rows
    give repeated results, no rows none; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.keep(docs.mapInArrow(_signatures(n, bands), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    classes = scratch.write(signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")

    rows = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.write(rows.join(shared.hint("merge"), ["band", "key"]), "members")
    met = members.select(F.col("node").alias("doc_id")).distinct()
    sets = scratch.write(docs.join(met.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(n), "node long, shingles array<long>"), "sets")

    stars = scratch.write(_stars(members, percent), "stars")
    first = scratch.write(connected_components(_verified(stars, sets, percent), scratch, "cc1"), "first")

    member = members.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    bucket = member.groupBy("band", "key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("band", "key")
    still = scratch.write(member.join(bucket, ["band", "key"]).select("band", "key", "n", "node", "n_shingles", "component"), "open")
    scratch.drop("members")
    small = still.where(F.col("n") <= SMALL_BUCKET)
    a, b = (small.select("band", "key", F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("component").alias(f"c_{x}")) for x in "uv")
    pairs = a.join(b, ["band", "key"]).where("u < v and c_u <> c_v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent).select("u", "v")
    large = still.where(F.col("n") > SMALL_BUCKET).select("node", "component").distinct()
    pairs = pairs.union(_by_prefix(large, sets, scratch, percent)).distinct()
    pairs = scratch.write(pairs.join(stars, ["u", "v"], "left_anti"), "open-pairs")
    more = _verified(pairs, sets, percent)
    # the stars of the first components stand for their links; without more links they are the answer
    known = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    joined = scratch.write(connected_components(known.union(more), scratch, "cc2"), "joined")
    scratch.drop("sets", "open-prefix", "open-pairs", "open", "stars", "first")

    of_class = classes.select("n_shingles", "k1", "k2", "node").join(joined, "node", "left").select("n_shingles", "k1", "k2", F.coalesce("component", "node").alias("component"))
    found = signed.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["n_shingles", "k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group, the one of the least doc_id; columns as they were, whatever their names.

    Rows that share a doc_id are one document: of those of a kept one the least row stays, by text and then by the other columns
    in order, so a rerun keeps the same one. Rows without doc_id stay, null, empty and blank texts are like no other. Very long
    texts are compared whole; no rows give no rows.
    """
    rows, (i, text) = unnamed(docs, id_col, text_col)
    keep = near_duplicates(rows, id_col=i, text_col=text).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n"))
    known = rows.join(keep.hint("merge"), F.col(i).cast("long") == F.col("_kept"))
    order = [F.col(c).asc_nulls_first() for c in [text, *rows.columns] if "map<" not in dict(rows.dtypes)[c] and "variant" not in dict(rows.dtypes)[c]]
    first = known.where("_n > 1").withColumn("_r", F.row_number().over(Window.partitionBy("_kept").orderBy(*order))).where("_r = 1")
    found = known.where("_n = 1").select(*rows.columns).union(first.select(*rows.columns)).union(rows.where(F.col(i).isNull()))
    return found.toDF(*docs.columns)
