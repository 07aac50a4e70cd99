"""Messages to work items and ledger columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(F.regexp_like(text, F.lit(r"\S")), F.lit(False))


def body_of(parts: Column, html_text: Column) -> Column:
    """Plain parts that aren't blank, joined by line feeds; without any the flattened markup."""
    plain = F.filter(parts, lambda p: (p["ctype"] == "text/plain") & ~blank(p["text"]))
    body = F.regexp_replace(F.array_join(F.transform(plain, lambda p: p["text"]), "\n"), r"^\s+|\s+$", "")
    return F.when(body != "", body).otherwise(F.coalesce(html_text, F.lit("")))


def images_of(parts: Column, least: int = fixed.MIN_ATTACHMENT_BYTES) -> Column:
    """Image parts of at least so many bytes; exactly as many count."""
    return F.filter(parts, lambda p: p["ctype"].startswith("image/") & (F.length(p["bytes"]) >= least))


def route(images: Column, html: Column, body: Column) -> Column:
    """images, if there are any, else message, if markup or body isn't blank, else skip."""
    return F.when(F.size(F.coalesce(images, F.array())) > 0, "images").when(blank(html) & blank(body), "skip").otherwise("message")


def work_items(messages: DataFrame) -> DataFrame:
    """messages: index, images array<string>, body_html, body_text and more. One item per image, or one for the message; skipped
    messages give none."""
    routed = messages.withColumn("route", route(F.col("images"), F.col("body_html"), F.col("body_text"))).where("route <> 'skip'")
    each = F.when(F.col("route") == "images", F.col("images")).otherwise(F.array(F.lit(None).cast("string")))
    return routed.withColumn("image", F.explode(each)).drop("images")


def label(subject: Column, sender: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(subject, F.lit("")), F.nullif(sender, F.lit("")), F.concat(F.lit("message "), (index + 1).cast("string")))


def mail_columns(message: DataFrame) -> DataFrame:
    """The ledger's mail columns: empty texts are null, senders are 'Name <address>'."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    sender = F.when(F.coalesce(F.col("sender_email"), F.lit("")) != "", F.trim(F.concat(F.coalesce(F.col("sender_name"), F.lit("")), F.lit(" <"), F.col("sender_email"), F.lit(">")))).otherwise(some("sender_name"))
    return message.select("*", some("message_id").alias("email_message_id"), some("subject").alias("email_subject"), sender.alias("email_from"), some("date").alias("email_date"))


def source_kind(is_mail: Column, rendered: Column, has_image: Column) -> Column:
    return F.when(~is_mail, "image").when(rendered, "email_render").when(has_image, "email_image").otherwise("email")


def validated(forms: DataFrame, default_currency: str = "IDR") -> DataFrame:
    """Reviewed forms (raw_date, raw_amount, name, category, currency, notes) to entries; error says why a form is rejected."""
    from ..functions.dates import parse_date_input
    from ..functions.money import parse_number

    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    currency = F.coalesce(F.nullif(F.upper(text("currency")), F.lit("")), F.lit(default_currency))
    date, amount = parse_date_input(F.col("raw_date"), currency), parse_number(text("raw_amount"))
    error = F.when(text("raw_date") == "", "date required").when(date.isNull(), "invalid date").when(text("raw_amount") == "", "amount required").when(amount.isNull(), "invalid amount")
    return forms.select("id", date.alias("entry_date"), F.coalesce(F.nullif(text("category"), F.lit("")), F.lit(fixed.OTHER_CATEGORY)).alias("category"), text("name").alias("name"), amount.cast("double").alias("amount"), currency.alias("currency"), F.nullif(text("notes"), F.lit("")).alias("notes"), error.alias("error"))
