"""Image files: Spark's binary source with hash and size; width and height from the file's header."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.fixed import IMAGE_SUFFIXES


def _size(data: bytes) -> tuple[int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None, None


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height of PNG, JPEG and BMP files as stored, null for others."""
    return pd.DataFrame([_size(bytes(c)) if c is not None else (None, None) for c in content], columns=["width", "height"]).astype("Int64")


def is_image(path):
    return F.lower(F.substring_index(path, ".", -1)).isin(IMAGE_SUFFIXES) & F.contains(path, F.lit("."))


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, width, height of every image file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(is_image(F.col("path")))
    size = image_size("content")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), size.alias("_size")).select("path", "bytes", "sha256", "_size.width", "_size.height")
