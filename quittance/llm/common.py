"""Shared ground of the training-data operators: the shared folder, scratch tables, text columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_files, shared_folder

#: Characters that end a word: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: How scratch tables are written: nothing reads the marker of success.
_MARKER = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def _plain(spark: SparkSession, where: str) -> dict[str, str]:
    """Settings for writing scratch tables. Without its native library Hadoop starts a process for each permission that it sets, and
    until that process has become another program it counts with all memory of the JVM that started it. On file:, a plain local
    file system sets them without; files get no checksum files. It is taken for these writes alone, so not from Hadoop's cache.
    Other stores keep their own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return _MARKER
    return _MARKER | {"fs.file.impl": local_files(spark), "fs.file.impl.disable.cache": "true"}


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_made: list[list[Scratch]] = []


@contextlib.contextmanager
def scratch_until_written(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that operators make inside go at the end, also those that their results read: for results that are written
    inside, too."""
    _made.append([])
    try:
        yield
    finally:
        for scratch in _made.pop():
            scratch.clear()


class Scratch:
    """Intermediate tables as Parquet in the shared folder, so that lost executors cost no lineage. Those of many parts that are
    one step from such tables or the input can be blocks on the executors' disks instead.

    ``drop`` removes those that were only steps on the way. Tables that a returned frame still reads stay until the end of
    ``scratch_until_written`` around it, else until the driver's file system is closed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.kept = spark, f"{shared_folder(spark)}/quittance-{uuid.uuid4().hex}", {}
        self.plain = _plain(spark, self.root)
        if _made:
            _made[-1].append(self)
        else:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            path, own = jvm.org.apache.hadoop.fs.Path(self.root), jvm.org.apache.hadoop.conf.Configuration(conf)
            for key, value in self.plain.items():
                own.set(key, value)
            path.getFileSystem(own).mkdirs(path)
            path.getFileSystem(conf).deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").options(**self.plain).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As ``write``, but in blocks on the executors' disks when it is first read. Spark makes a lost block again from df, and
        no file system starts a process for one."""
        # a value of its own, as Spark would take the blocks of an earlier call for an equal plan, whatever its files hold by now
        self.kept[name] = df.withColumn("_kept_by", F.lit(uuid.uuid4().int >> 65)).persist(StorageLevel.DISK_ONLY)
        return self.kept[name].select(*df.columns)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.kept:
                self.kept.pop(name).unpersist()
            else:
                _delete(self.spark, f"{self.root}/{name}")

    def clear(self) -> None:
        self.drop(*self.kept)
        _delete(self.spark, self.root)


def memory_back() -> None:
    """Hands what a Python worker has freed back to the system; its allocators keep it otherwise, while the worker waits idly."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over the batches of a task, then memory_back, when nothing of run is held any more."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        memory_back()

    return wrapped


def unnamed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1 and so on, so that no name of an operator's own can clash with one of them, and what the
    given columns are called now. toDF(*df.columns) gives the names back."""
    at = {c.lower(): f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), [at[n.lower()] for n in names]


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; one scan of one column."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0])


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z only, whatever the locale or script."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
