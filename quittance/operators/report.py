"""Reports: sums by currency, printed totals, CSV rows, the index with page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.money import format_money, plain_money
from ..functions.names import sanitize


def currency_of(default: str) -> Column:
    """The currency as stored, or the default for null and ''; not trimmed."""
    return F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit(default))


def read_amount() -> Column:
    """amount as a number: null and '' are 0, unreadable text is null."""
    text = F.coalesce(F.nullif(F.trim(F.col("amount").cast("string")), F.lit("")), F.lit("0"))
    return F.regexp_replace(text, "_", "?").try_cast("double")


def summarize(rows: DataFrame, default_currency: str = "") -> DataFrame:
    """One row per currency: entries, total, and all_entries, which counts unreadable amounts too; those make no group."""
    read = rows.select(currency_of(default_currency).alias("currency"), read_amount().cast("decimal(18,2)").alias("value"))
    sums = read.where("value is not null").groupBy("currency").agg(F.count("*").alias("entries"), F.sum("value").cast("double").alias("total"))
    return sums.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all_entries"))))


def format_totals(sums: DataFrame) -> DataFrame:
    """One row: every currency's total, by currency, never a mixed sum. As many parts as there are currencies."""
    parts = sums.select("currency", format_money(F.col("total"), F.col("currency")).alias("text"))
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("currency", "text"))), lambda x: x["text"]), " · ").alias("totals"))


def csv_rows(rows: DataFrame, default_currency: str = "") -> DataFrame:
    """What a CSV line holds: null texts are '', amounts have two decimals, null ones are 0.00, unreadable ones ''."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    amount = F.coalesce(plain_money(read_amount()), F.lit(""))
    return rows.select("id", text("entry_date").alias("date"), text("category").alias("category"), text("name").alias("expense_detail"), amount.alias("amount"), currency_of(default_currency).alias("currency"))


def write_csv(rows: DataFrame, path: str, default_currency: str = "") -> int:
    """One CSV file with a byte order mark, CRLF between rows and line feeds inside fields as they are; returns its rows. Rows come
    by partition, in the frame's order."""
    import csv

    count = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(fixed.CSV_HEADER)
        for row in csv_rows(rows, default_currency).drop("id").toLocalIterator():
            out.writerow(list(row))
            count += 1
    return count


def index_entries(rows: DataFrame, default_currency: str = "") -> DataFrame:
    """Cleaned fields of an index line; here null and unreadable amounts are ''."""
    value = F.regexp_replace(F.trim(F.col("amount").cast("string")), "_", "?").try_cast("double")
    clean = lambda c: sanitize(F.coalesce(F.col(c), F.lit("")))
    return rows.select("id", clean("entry_date").alias("date"), clean("category").alias("category"), clean("name").alias("detail"), F.coalesce(format_money(value, currency_of(default_currency)), F.lit("")).alias("amount"))


def pages_of(width: Column, height: Column) -> Column:
    """Pages an image takes: one if it fits well enough, else slices at full width."""
    p = fixed.PAGE
    by_width, by_height = F.least(F.lit(1.0), p["width"] / width), F.least(F.lit(1.0), p["first"] / height)
    tall = F.when(by_width == 1, height.cast("long")).otherwise(F.greatest(F.lit(1), F.bround(height * by_width, 0)).cast("long"))
    rest = F.ceil(F.greatest(F.lit(0), tall - p["first"] - p["next"] + p["overlap"]) / (p["next"] - p["overlap"]))
    return F.when((by_height >= p["fit"] * by_width) | (tall <= p["first"]), 1).otherwise(2 + rest).cast("long")


def page_numbers(entries: DataFrame, report: list[str], order: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """Adds number, index_page, pages and page within each report: its index pages come first, then each entry behind those
    before it. Entries without an image take one page."""
    rows = entries.withColumn("pages", F.when(F.col(width).isNull() | F.col(height).isNull(), F.lit(1).cast("long")).otherwise(pages_of(F.col(width), F.col(height))))
    w, whole = Window.partitionBy(*report).orderBy(*order), Window.partitionBy(*report)
    index_pages = F.greatest(F.lit(1), F.ceil(F.count("*").over(whole) / fixed.PAGE["index_rows"]))
    before = F.coalesce(F.sum("pages").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(w)
    return rows.select("*", number.cast("long").alias("number"), (F.floor((number - 1) / fixed.PAGE["index_rows"]) + 1).alias("index_page"), (index_pages + 1 + before).alias("page"))


def drop_repeats(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Without rows equal to the one just before them; equal rows further apart stay."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def expected_origin(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds origin: scan if that file exists, else for an existing source original, or if it is a mailbox redrawn with a message id
    and none without; none otherwise. files: path."""
    known = files.select("path").distinct()
    met = rows.join(known.select(F.col("path").alias("scanned_path"), F.lit(True).alias("_scan")), "scanned_path", "left").join(known.select(F.col("path").alias("source_path"), F.lit(True).alias("_source")), "source_path", "left")
    box = F.lower("source_path").endswith(".mbox")
    has_id = F.coalesce(F.col("email_message_id"), F.lit("")) != ""
    origin = F.when(F.col("_scan"), "scan").when(F.col("_source") & box & has_id, "redrawn").when(F.col("_source") & ~box, "original").otherwise("none")
    return met.withColumn("origin", origin).drop("_scan", "_source")


def message_lookup(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """entries: id, source_path, email_message_id. The first message of that mailbox and id (spaces around ids don't count), else
    null."""
    first = messages.where(F.trim("message_id") != "").groupBy(F.col("mbox_path").alias("source_path"), F.trim("message_id").alias("_id")).agg(F.min("index").alias("message_index"))
    return entries.withColumn("_id", F.trim("email_message_id")).join(first, ["source_path", "_id"], "left").select("id", "message_index")
