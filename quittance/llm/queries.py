"""One query per training-data operator, over its whole table with production parameters; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import license_scan, mixing
from .ann import nearest_neighbours
from .common import read
from .fingerprints import fingerprint_edits, similar_groups
from .license_texts import scan_license_texts
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality import score_quality
from .substring_dedup import substring_duplicates
from .toxicity import score_toxicity
from .url_filter import RULES, filter_urls


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op2_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_license_texts(read(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(read(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))


def op6_similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method's other half: bands of the same signatures joined, Jaccard verified on full sets."""
    return similar_groups(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_license_scan, op2_license_texts, op3_near_dedup, op4_substring_dedup, op5_ann, op6_fingerprints, op6_similar_groups, op7_toxicity, op8_mixing, op9_url_filter, op10_quality)}
ORACLE = {"op2_license_scan": license_scan.oracle(), "op8_mixing": mixing.ORACLE}
