"""The ledger: keys, lookups, ranges, upserts, duplicate collapse, schema upgrade. Plain relational plans throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..functions.names import normalize_title

#: Columns a caller writes, with their types; the engine owns id, dedupe_key, created_at and updated_at.
COLUMNS = {
    **dict.fromkeys(["source_kind", "email_message_id", "email_subject", "email_from", "email_date", "source_path", "source_filename", "scanned_path", "archived_path", "ocr_text", "ocr_text_raw", "ocr_lang"], "string"),
    "ocr_confidence": "double", "ocr_word_count": "long", **dict.fromkeys(["entry_date", "category", "name"], "string"), "amount": "double", **dict.fromkeys(["currency", "notes"], "string"),
    **dict.fromkeys(["source_width", "source_height", "source_bytes"], "long"), "source_sha256": "string", "scanned_width": "long", "scanned_height": "long",
    **dict.fromkeys(["exif_datetime", "camera_make", "camera_model"], "string"), "document_detected": "int", "deskew_angle": "double",
}


def conform(rows: DataFrame) -> DataFrame:
    """Rows of any columns to the ledger's: unknown ones go, missing ones are null, except source_kind, which is 'image'."""
    have = {c.lower() for c in rows.columns}
    out = [F.col(c).cast(t).alias(c) if c in have else F.lit("image" if c == "source_kind" else None).cast(t).alias(c) for c, t in COLUMNS.items()]
    return rows.select(*[c for c in ("id", "created_at", "updated_at", "seq") if c in have], *out)


def key_parts() -> Column:
    """struct<title, cents, currency, date> that equal entries share, null where one of title, amount or date is missing. Group by
    the struct; the text form is for output. Titles are compared in NFKC and case folded."""
    title = normalize_title(F.col("name"))
    date = F.trim(F.coalesce(F.col("entry_date"), F.lit("")))
    key = F.struct(title.alias("title"), cents(F.col("amount")).alias("cents"), F.upper(F.trim(F.coalesce("currency", F.lit("")))).alias("currency"), date.alias("date"))
    return F.when((key["title"] != "") & key["cents"].isNotNull() & (date != ""), key)


def key_text(key: Column) -> Column:
    """A key as a compact JSON array."""
    escape = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(key.isNotNull(), F.concat(F.lit('["'), escape(key["title"]), F.lit('",'), key["cents"].cast("string"), F.lit(',"'), escape(key["currency"]), F.lit('","'), escape(key["date"]), F.lit('"]')))


def entries_between(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Entries whose date is in the closed range, by date and id; ends in the wrong order are swapped."""
    low, high = min(start, end), max(start, end)
    return rows.where(F.col("entry_date").between(low, high) & (F.col("entry_date") != "")).orderBy("entry_date", "id")


def date_bounds(rows: DataFrame) -> DataFrame:
    return rows.where("entry_date <> ''").agg(F.min("entry_date").alias("first"), F.max("entry_date").alias("last"))


def recent(rows: DataFrame, limit: int = 200) -> DataFrame:
    return rows.orderBy(F.desc("id")).limit(limit)


def latest_by(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """For each wanted key the id of the latest entry that has it; empty keys find none. wanted: one column named key."""
    last = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max("id").alias("id"))
    return wanted.join(last, key, "left")


def summary(rows: DataFrame) -> DataFrame:
    """Entries and sum of amounts by currency, '' for none; sums in decimals, so that they don't depend on order."""
    return rows.groupBy(F.coalesce("currency", F.lit("")).alias("currency")).agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("total"))


def duplicate_warning(items: DataFrame, rows: DataFrame) -> DataFrame:
    """items: item, email_message_id, source_sha256. Adds entry_id, the latest entry with the item's hash, or without a hash with
    its message id; null if there is none."""
    by = {c: rows.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c).agg(F.max("id").alias(f"by_{c}")) for c in ("source_sha256", "email_message_id")}
    met = items.join(by["source_sha256"], "source_sha256", "left").join(by["email_message_id"], "email_message_id", "left")
    has = F.coalesce(F.col("source_sha256"), F.lit("")) != ""
    return met.select("item", F.when(has, F.col("by_source_sha256")).otherwise(F.col("by_email_message_id")).alias("entry_id"))


def not_yet_queued(paths: DataFrame, queued: DataFrame) -> DataFrame:
    """Distinct paths that aren't queued yet."""
    return paths.select("path").dropDuplicates(["path"]).join(queued.select("path"), "path", "left_anti")


def collapse_duplicates(rows: DataFrame, key: Column | None = None) -> DataFrame:
    """Of entries with one key the least id stays, with the first non-blank notes by id if its own are blank. Entries without a
    key stay. Aggregated before the exchange, so a key that most entries share is no hot task."""
    rows = rows.withColumn("_key", key_parts() if key is None else key)
    filled = F.trim(F.coalesce(F.col("notes"), F.lit(""))) != ""
    keyed = rows.where("_key is not null").groupBy("_key").agg(F.min("id").alias("_keep"), F.min(F.when(filled, F.struct("id", "notes"))).alias("_notes"))
    kept = rows.where("_key is not null").join(keyed.select("_keep", "_notes"), F.col("id") == F.col("_keep"))
    kept = kept.withColumn("notes", F.when(filled, F.col("notes")).otherwise(F.coalesce("_notes.notes", "notes"))).drop("_keep", "_notes")
    return kept.unionByName(rows.where("_key is null")).drop("_key")


def upsert(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Inserts in the order of events.seq. An event whose key is known updates that entry: its columns count, blank notes keep the
    notes there were, id and created_at stay. Others get the next ids in order; events without a key are always new.

    rows: id, created_at, updated_at and columns; events: seq, at and columns.
    """
    columns = [c for c in events.columns if c not in ("seq", "at", "id")]
    old = rows.select(F.lit(-1).cast("long").alias("seq"), "id", F.col("created_at").alias("at"), "updated_at", *columns)
    new = events.select(F.col("seq").cast("long").alias("seq"), F.lit(None).cast("long").alias("id"), "at", F.col("at").alias("updated_at"), *columns)
    every = old.unionByName(new).withColumn("_key", key_parts())
    single = every.where("_key is null").select(F.col("seq").alias("_first"), "id", F.col("at").alias("created_at"), "updated_at", *columns)
    filled = F.trim(F.coalesce(F.col("notes"), F.lit(""))) != ""
    last = F.max_by(F.struct("updated_at", *columns), F.col("seq"))
    noted = F.max_by("notes", F.when(filled, F.col("seq")))
    merged = every.where("_key is not null").groupBy("_key").agg(F.min("seq").alias("_first"), F.max("id").alias("id"), F.min_by("at", "seq").alias("created_at"), last.alias("_last"), noted.alias("_noted"), F.min_by("notes", "seq").alias("_first_notes"))
    merged = merged.select("_first", "id", "created_at", "_last.updated_at", *[F.coalesce("_noted", "_first_notes").alias("notes") if c == "notes" else F.col(f"_last.{c}").alias(c) for c in columns])
    return numbered(merged.unionByName(single))


def numbered(rows: DataFrame) -> DataFrame:
    """Ids for new entries, after the largest known, by first event. Ranges of events are counted first, so that no task orders
    all of them."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = rows.where("id is null").withColumn("_part", F.floor(F.col("_first") / 65536))
    before = fresh.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_first"))).join(before, "_part").crossJoin(F.broadcast(top))
    fresh = ranked.withColumn("id", F.col("_top") + F.col("_before") + F.col("_r")).drop("_part", "_r", "_before", "_top")
    return rows.where("id is not null").unionByName(fresh).drop("_first")


def unique_violations(rows: DataFrame) -> DataFrame:
    """Keys that several entries have; empty for a sound ledger."""
    return rows.withColumn("_key", key_parts()).where("_key is not null").groupBy("_key").agg(F.count("*").alias("entries")).where("entries > 1").select(key_text(F.col("_key")).alias("dedupe_key"), "entries")


def delete_entries(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def upgrade(rows: DataFrame) -> DataFrame:
    """A ledger of an older schema to today's: missing columns filled, duplicates collapsed, keys written."""
    return collapse_duplicates(conform(rows)).withColumn("dedupe_key", key_text(key_parts()))
