"""Bounded samples of labelled documents, for classifiers that are fitted in the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_table(docs: DataFrame, labels: DataFrame, label: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _y) of at most ``limit`` labelled documents that aren't held out, the least by hash of their id. Null ids, texts
    and labels are left out; of several labels of an id the largest counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    # at most ``limit`` rows of two numbers
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(known), "_id").select("_id", "_text", "_y")


def in_order() -> list[Column]:
    """The fixed order in which classifiers see a training table."""
    return [F.xxhash64("_id"), F.col("_id"), F.col("_text")]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> Iterator[tuple[int, str, int]]:
    """(id, text, label) of the training table in order; rows reach the driver one partition at a time."""
    for row in training_table(docs, labels, label, limit, id_col=id_col, text_col=text_col).orderBy(*in_order()).toLocalIterator():
        yield row["_id"], row["_text"], row["_y"]
