"""A receipt's text to its five fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import extract_date
from .money import detect_currency, extract_amount, format_amount, let
from .names import extract_name, guess_category, normalize


def parse_receipt(text: Column, allowed: list[str], fallback_date: str = "", default_currency: str = "") -> Column:
    """struct<entry_date, category, name, amount, currency>, all strings, '' for unknown. A blank text has the fallback date and
    category and no currency, not even the default one. Rules read the text in NFKC."""
    text = normalize(text)
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""

    def fields(x):
        known = {
            "entry_date": F.when(x["blank"], fallback_date).otherwise(F.coalesce(extract_date(x["text"], x["currency"]), F.lit(fallback_date))),
            "category": guess_category(F.when(x["blank"], "").otherwise(x["text"]), allowed),
            "name": F.when(x["blank"], "").otherwise(F.coalesce(extract_name(x["text"]), F.lit(""))),
            "amount": F.when(x["blank"], "").otherwise(format_amount(extract_amount(x["text"], x["currency"]))),
            "currency": F.when(x["blank"], "").otherwise(x["currency"]),
        }
        return F.struct(*[v.alias(k) for k, v in known.items()])

    return let(F.struct(text.alias("text"), blank.alias("blank"), detect_currency(text, default_currency).alias("currency")), fields)
