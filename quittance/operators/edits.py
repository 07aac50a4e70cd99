"""A ledger under inserts and edits in order, and versions of it as snapshots.

An edit can move an entry from one key to another and merge it there, so entries, keys and events hang together. Those that do
are found as connected components and folded in order within each; components are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .ledger import key_parts, key_text, numbered


def _components(links: DataFrame) -> DataFrame:
    """links: (x, y) strings. (node, component) by the least label, pointers doubled each round; lineage is cut by checkpoints."""
    spark = links.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    both = links.union(links.select("y", "x")).toDF("node", "near").distinct().checkpoint()
    labels = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("label")).checkpoint()
    while True:
        heard = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("l")), "near").groupBy("node").agg(F.min("l").alias("l"))
        after = labels.join(heard, "node").select("node", F.least("label", "l").alias("label"))
        after = after.join(after.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")).checkpoint()
        if after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty():
            return after.withColumnRenamed("label", "component")
        labels = after


def apply_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows: id, created_at, updated_at and columns; events: seq (from 0), record_id (null for a new entry), at and columns.

    In the order of seq: an event whose key another entry has updates that one, keeping its notes if it brings none, and an edited
    entry goes; else an edited entry is updated in place, notes and all; a record_id that isn't there inserts. Inserts take the
    next ids in order, and no id is given twice.
    """
    columns = [c for c in events.columns if c not in ("seq", "record_id", "at")]
    old = rows.withColumn("seq", F.lit(-1).cast("long")).withColumn("record_id", F.col("id").cast("long")).withColumn("at", F.col("created_at"))
    new = events.withColumn("seq", F.col("seq").cast("long")).withColumn("record_id", F.col("record_id").cast("long")).withColumn("updated_at", F.col("at"))
    every = old.select("seq", "record_id", "at", "updated_at", *columns).unionByName(new.select("seq", "record_id", "at", "updated_at", *columns))
    every = every.withColumn("_key", key_text(key_parts()))
    ident = F.concat(F.lit("i"), F.col("record_id").cast("string"))
    own = F.when(F.col("record_id").isNotNull(), ident).when(F.col("_key").isNotNull(), F.concat(F.lit("k"), "_key")).otherwise(F.concat(F.lit("s"), F.col("seq").cast("string")))
    every = every.withColumn("_node", own)
    # entries that inserts make may be edited later by id; ids of one batch aren't known to its callers, so none are linked
    links = every.where("record_id is not null and _key is not null").select(F.col("_node").alias("x"), F.concat(F.lit("k"), "_key").alias("y"))
    found = every.join(_components(links), every["_node"] == F.col("node"), "left").withColumn("_part", F.coalesce("component", "_node")).drop("node", "component")
    schema = "id long, _first long, _gone boolean, created_at string, updated_at string, " + ", ".join(f"{c} {dict(events.dtypes)[c]}" for c in columns)

    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        entries: dict = {}
        holder: dict = {}  # the entry that has a key
        gone: list = []

        def put(name, values):
            was = entries.get(name, {})
            if was.get("_key") is not None and holder.get(was["_key"]) == name:
                del holder[was["_key"]]
            entries[name] = was | values
            if entries[name]["_key"] is not None:
                holder.setdefault(entries[name]["_key"], name)

        for e in batch.sort_values(["seq", "record_id"]).astype(object).where(batch.notna(), None).to_dict("records"):
            values = {c: e[c] for c in columns}
            stamp = {"_key": e["_key"], "updated_at": e["updated_at"]}
            if e["seq"] < 0:
                put(("i", e["record_id"]), values | stamp | {"id": e["record_id"], "_first": -1, "created_at": e["at"]})
                continue
            target = name = None if e["record_id"] is None else ("i", e["record_id"])
            match = holder.get(e["_key"])
            if match is not None and match != name:
                target = match
                if name in entries:
                    put(name, {"_key": None})
                    gone.append(entries.pop(name))
                if not (values.get("notes") or "").strip():
                    values["notes"] = entries[match].get("notes")
            if target in entries:
                put(target, values | stamp)
            else:
                put(("s", e["seq"]), values | stamp | {"id": None, "_first": e["seq"], "created_at": e["at"]})
        rows = [x | {"_gone": False} for x in entries.values()] + [x | {"_gone": True} for x in gone]
        out = pd.DataFrame(rows, columns=["id", "_first", "_gone", "created_at", "updated_at", *columns])
        return out.astype({"id": "Int64", "_first": "int64", "_gone": "bool"})

    # an entry that is gone keeps its id from being given again
    return numbered(found.groupBy("_part").applyInPandas(fold, schema)).where("not _gone").drop("_gone")


class Snapshots:
    """Versions of a table in one folder: a new one is written beside the old and becomes current by renaming a small file, so a
    write that fails changes nothing, and the version before stays as a backup."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.fs.exists(self.path(self.root)):
            return []
        names: Iterator[str] = (s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)))
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))

    def read(self) -> DataFrame | None:
        known = self.versions()
        return self.spark.read.parquet(f"{self.root}/v{known[-1]}") if known else None

    def write(self, rows: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/v{version}")
        self.fs.create(self.path(f"{self.root}/.current-{version}"), True).close()
        if not self.fs.rename(self.path(f"{self.root}/.current-{version}"), self.path(f"{self.root}/current-{version}")):
            raise RuntimeError(f"version {version} was written by someone else")
        return version
