"""Connected components of an edge table by alternating large-star and small-star rounds, nothing collected."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours (large: those above it; small: those below it) to the least of them and itself."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = near.join(least, "u")
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return met.select(F.col("v").alias("x"), "u", "m").select(F.inline(F.array(
        F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
    ))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one neighbour below it or is the end of all its edges: the table is of stars, whose centres are least."""
    ends = edges.select(F.col("u").alias("x"), "v").union(edges.select(F.col("v").alias("x"), "v"))
    return not ends.groupBy("x").agg((F.min("v") < F.max("v")).alias("open")).agg(F.max("open")).first()[0]


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: (u, v) longs, any direction, repeats and loops allowed. Returns (node, component) for every node that has an
    edge to another one; component is the least node of its component. Rounds grow with the logarithm of the nodes; edges that
    are stars already need none, as one sum over them tells."""
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for k in itertools.count(1):
        if _settled(now):
            break
        now = scratch.write(_star(_star(now, True), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
