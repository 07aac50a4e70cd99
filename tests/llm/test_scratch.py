"""Scratch tables: few processes on the way, rows as they were, nothing left behind, nothing taken from an earlier call."""

import os
import re
import subprocess
import sys
from pathlib import Path

from quittance import session
from quittance.llm import common
from quittance.llm.near_dup import near_duplicates

RUN = """
from quittance.llm.near_dup import near_duplicates
from quittance.session import local_session
spark = local_session("2", 2, "1g")
words = [f"w{k}" for k in range(40)]
rows = [(k, " ".join(words[: 40 - k % 2])) for k in range(8)] + [(9, None)]
docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
print("found", sorted(tuple(r) for r in near_duplicates(docs).select("doc_id", "component_id").collect()))
"""


def test_near_duplicates_start_few_processes(tmp_path):
    """Hadoop calls chmod where its native library is missing; here a script of that name writes down what for."""
    log, chmod = tmp_path / "log", tmp_path / "bin" / "chmod"
    chmod.parent.mkdir()
    chmod.write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec /bin/chmod "$@"\n')
    chmod.chmod(0o755)
    env = os.environ | {"PATH": f"{chmod.parent}:{os.environ['PATH']}", "PYTHONPATH": str(Path(common.__file__).parents[2])}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    out = subprocess.run([sys.executable, "-c", RUN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180).stdout
    assert f"found {sorted([(k, 0) for k in range(8)] + [(9, 9)])}" in out
    calls = log.read_text().splitlines() if log.exists() else []
    assert not [c for c in calls if "/signed" in c or c.endswith(".crc")]


CLUSTER = """
import sys
from pyspark.sql import SparkSession
from quittance.llm.substring_dedup import drop_repeated_passages
from quittance.session import ship
where = sys.argv[1]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{where}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
ship(spark)
words = [f"w{k}" for k in range(80)]
docs = spark.createDataFrame([(k, " ".join(words[k:] + [f"x{k}"])) for k in range(6)], "doc_id long, text string").repartition(2)
print("found", sorted(len(r.text.split()) for r in drop_repeated_passages(docs).collect()))
"""


def test_scratch_tables_on_a_cluster_start_no_process(tmp_path):
    """Neither the driver nor an executor; a process counts with all memory of its JVM until it has become another program."""
    log, chmod = tmp_path / "log", tmp_path / "bin" / "chmod"
    chmod.parent.mkdir()
    chmod.write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec /bin/chmod "$@"\n')
    chmod.chmod(0o755)
    env = os.environ | {"PATH": f"{chmod.parent}:{os.environ['PATH']}", "PYTHONPATH": str(Path(common.__file__).parents[2]), "SPARK_WORKER_DIR": str(tmp_path / "work"), "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    out = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert f"found {[1] * 5 + [81]}" in out.stdout, out.stderr[-2000:]
    calls = log.read_text().splitlines() if log.exists() else []
    assert not [c for c in calls if re.search("/quittance-[0-9a-f]{32}", c)]


def test_scratch_tables_have_the_permissions_of_other_tables(spark, tmp_path, monkeypatch):
    def modes(folder):
        return {p.suffix: p.stat().st_mode for p in [folder, *folder.rglob("part-*.parquet")]}

    spark.range(5).write.parquet(f"{tmp_path}/other")
    for kind in (session.local_files(spark), session._PLAIN):
        monkeypatch.setitem(session._local_files, spark.sparkContext.applicationId, kind)
        with common.scratch_until_written(spark):
            scratch = common.Scratch(spark)
            assert scratch.plain["fs.file.impl"] == kind and scratch.write(spark.range(5), "rows").count() == 5
            assert modes(Path(scratch.root.removeprefix("file:")) / "rows") == modes(tmp_path / "other")


def test_scratch_tables_have_no_checksum_files_and_keep_their_rows(spark):
    with common.scratch_until_written(spark):
        scratch = common.Scratch(spark)
        found = scratch.write(spark.range(50).repartition(3), "rows")
        folder = Path(scratch.root.removeprefix("file:"))
        assert not list(folder.rglob("*.crc"))
        assert list(folder.rglob("part-*.parquet")) and sorted(r.id for r in found.collect()) == list(range(50))
    assert not folder.exists()


def test_kept_tables_go_and_are_not_those_of_an_earlier_call(spark, tmp_path):
    path, held = str(tmp_path / "in"), lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held()
    with common.scratch_until_written(spark):
        scratch = common.Scratch(spark)
        first = scratch.keep(spark.read.schema("id long").parquet(_table(path, 1, 2)), "rows")
        assert first.columns == ["id"] and sorted(r.id for r in first.collect()) == [1, 2]
        other = scratch.keep(spark.read.schema("id long").parquet(_table(path, 3)), "more")
        assert [r.id for r in other.collect()] == [3]
        scratch.drop("more")
        assert held() == before + 1
    assert held() == before


def _table(path, *ids):
    """Written past Spark, which would forget what it holds of a path that it writes to itself."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(path, exist_ok=True)
    pq.write_table(pa.table({"id": pa.array(ids, pa.int64())}), f"{path}/part-0.parquet")
    return path


def test_a_result_stays_right_when_its_blocks_are_lost(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    found = near_duplicates(docs)
    rows = lambda: sorted((r.doc_id, r.component_id, r.kept) for r in found.collect())
    assert rows() == [(1, 1, True), (2, 1, False), (3, 3, True)]
    spark.catalog.clearCache()
    assert rows() == [(1, 1, True), (2, 1, False), (3, 3, True)]
