"""Recognised words to text and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mail import blank


def rebuild_text(words: DataFrame, doc: str = "doc") -> DataFrame:
    """words: doc, text, conf, page_num, block_num, par_num, line_num, word_num. One row per doc: text (words by line, lines by
    place), mean_confidence (of words at 0 or more, two digits, else 0.0), word_count (words that aren't blank).

    Words combine by line before lines combine by document. conf may be text.
    """
    filled = ~blank(F.col("text"))
    conf = F.col("conf").cast("string").try_cast("double")
    counted = filled & (conf >= 0)
    rows = words.select(doc, F.struct("page_num", "block_num", "par_num", "line_num").alias("line"), F.when(filled, F.struct("word_num", "text")).alias("word"), F.when(counted, conf.cast("decimal(18,6)")).alias("conf"))
    lines = rows.groupBy(doc, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list("word")), lambda x: x["text"]), " ").alias("text"), F.count("word").alias("n"), F.sum("conf").alias("total"), F.count("conf").alias("known"))
    docs = lines.groupBy(doc).agg(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("line", "text")))).alias("lines"), F.sum("n").alias("word_count"), F.sum("total").alias("total"), F.sum("known").alias("known"))
    mean = F.coalesce(F.round(F.col("total").cast("double") / F.nullif(F.col("known"), F.lit(0)), 2), F.lit(0.0))
    return docs.select(doc, F.trim(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("text"), mean.alias("mean_confidence"), "word_count")
