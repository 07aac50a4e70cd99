"""What becomes of processed documents: file names, fallbacks between sources, plain-text layout, recognition as a boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.names import safe_name, sanitize


def output_names(files: DataFrame, at: Column, template: str = "{stem}_{hash8}") -> DataFrame:
    """files: source_path, sha256. Adds filename from the template ({stem} {name} {hash8} {hash} {ts} {date}; .png without a
    suffix); equal names get -1, -2, ... in the order of paths."""
    base = F.substring_index("source_path", "/", -1)
    stem = F.when(F.instr(base, ".") > 1, F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    values = {"stem": safe_name(stem, "receipt"), "name": safe_name(base, "receipt"), "hash8": F.left("sha256", F.lit(8)), "hash": F.col("sha256"), "ts": F.date_format(at, "yyyyMMdd-HHmmss"), "date": F.date_format(at, "yyyy-MM-dd")}
    name = F.lit(template)
    for k, v in values.items():
        name = F.replace(name, F.lit("{" + k + "}"), v)
    name = F.when(F.regexp_like(name, F.lit(r"[^.]\.[^.]+$")), name).otherwise(F.concat(name, F.lit(".png")))
    rows = files.withColumn("_name", name).withColumn("_n", F.row_number().over(Window.partitionBy("_name").orderBy("source_path")) - 1)
    numbered = F.concat(F.regexp_replace("_name", r"\.[^.]*$", ""), F.lit("-"), F.col("_n").cast("string"), F.regexp_extract("_name", r"\.[^.]*$", 0))
    return rows.withColumn("filename", F.when(F.col("_n") == 0, F.col("_name")).otherwise(numbered)).drop("_name", "_n")


def archive_name(source_path: Column, sha256: Column) -> Column:
    base = F.substring_index(source_path, "/", -1)
    return F.concat(safe_name(F.regexp_replace(base, r"\.[^.]*$", ""), "receipt"), F.lit("_"), F.left(sha256, F.lit(8)), F.lower(F.regexp_extract(base, r"\.[^.]*$", 0)))


def report_name(start: Column, end: Column, attachments: bool = False) -> Column:
    return F.concat(F.lit("receipts_"), start, F.lit("_to_"), end, F.lit("_attachments.pdf" if attachments else ".csv"))


def fallback_date(exif: Column, mail_day: Column) -> Column:
    """The day a picture was taken, else the mail's day, else ''."""
    return F.coalesce(F.nullif(F.split_part(exif, F.lit(" "), F.lit(1)), F.lit("")), F.nullif(mail_day, F.lit("")), F.lit(""))


def merchant(printed: Column, mail_guess: Column, rendered: Column) -> Column:
    """What a picture prints goes before the mail's guess; for a rendered mail the guess goes first."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.when(rendered, F.coalesce(some(mail_guess), some(printed), F.lit(""))).otherwise(F.coalesce(some(printed), some(mail_guess), F.lit("")))


def header_lines(subject: Column, sender: Column, at: Column) -> Column:
    """Lines above a rendered mail: subject, From, Date; those without a value are left out."""
    text = lambda c: F.nullif(sanitize(F.coalesce(c, F.lit(""))), F.lit(""))
    lines = F.array(text(subject), F.concat(F.lit("From: "), text(sender)), F.concat(F.lit("Date: "), F.date_format(at, "dd/MM/yyyy HH:mm")))
    return F.filter(lines, lambda x: x.isNotNull())


def wrap(text: Column, limit: int) -> Column:
    """Greedy lines of at most limit characters; a longer word has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def step(lines, word):
        last = F.element_at(lines, -1)
        joined = F.concat(last, F.lit(" "), word)
        return F.when(F.size(lines) == 0, F.array(word)).when(F.length(joined) <= limit, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(joined))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def fit(text: Column, limit: int) -> Column:
    """At most limit characters, the last an ellipsis if something is cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…")))


def resolve_image(rows: DataFrame) -> DataFrame:
    """rows: scan, redrawn, original (binary or null each). Adds image and origin, the first that is there."""
    order = ["scan", "redrawn", "original"]
    origin = F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in order], F.lit("none"))
    return rows.withColumn("image", F.coalesce(*order)).withColumn("origin", origin)


def recognise(images: DataFrame, engine: Callable[[], Callable[[bytes], tuple[str, list]]]) -> DataFrame:
    """images: id, content. engine() makes, once per worker, a function from bytes to (text, word confidences). A picture that
    fails has the reason in error and ends nothing."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        read = engine()
        for batch in batches:
            out = []
            for i, content in zip(batch["id"], batch["content"], strict=True):
                try:
                    text, conf = read(bytes(content))
                    known = [c for c in conf if c >= 0]
                    out.append((i, text, round(sum(known) / len(known), 2) if known else 0.0, len(conf), None))
                except Exception as e:
                    out.append((i, "", 0.0, 0, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["id", "text", "mean_confidence", "word_count", "error"])

    return images.select("id", "content").mapInPandas(run, "id long, text string, mean_confidence double, word_count long, error string")


def compare_fields(expected: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose fields differ, or that one side lacks: key, field, expected, found."""
    sides = [df.select(F.col(key).alias(f"k_{n}"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(n)) for df, n in ((expected, "e"), (found, "f"))]
    met = sides[0].join(sides[1], F.col("k_e") == F.col("k_f"), "full_outer")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").alias("expected"), F.col(f"f.{f}").alias("found")) for f in fields])
    rows = met.select(F.coalesce("k_e", "k_f").alias(key), F.col("k_e").isNull() | F.col("k_f").isNull(), F.inline(each)).toDF(key, "_lacks", "field", "expected", "found")
    return rows.where(F.col("_lacks") | ~F.col("expected").eqNullSafe(F.col("found"))).drop("_lacks")


MAX_PLACEHOLDER_LINES = 40


def placeholder(lines: Column) -> Column:
    """At most 40 lines, and an ellipsis if there were more."""
    return F.when(F.size(lines) <= MAX_PLACEHOLDER_LINES, lines).otherwise(F.concat(F.slice(lines, 1, MAX_PLACEHOLDER_LINES), F.array(F.lit("…"))))


def supported(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(fixed.IMAGE_SUFFIXES)
