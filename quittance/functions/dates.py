"""Dates in text, as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .money import detect_currency, let

#: Decimal digits of all scripts but ASCII, each script's from 0 to 9.
_DIGITS = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd")
_NAMES = "|".join(sorted(fixed.MONTHS, key=len, reverse=True))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text, else null. Two-digit years under 70 are of this century; only 1990 to 2100 count."""
    year = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    iso = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.between(1990, 2100) & month.between(1, 12) & day.between(1, 31), F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))


def month_number(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in fixed.MONTHS.items() for x in kv]), F.lower(name))


def _first(text: Column, pattern: str, date) -> Column:
    """The first match of a pattern that is a valid date; date maps the text of its groups to ISO or null."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)" + pattern), F.lit(0))
    inner = r"(?U)^" + pattern.removeprefix(r"\b").removesuffix(r"\b")
    groups = F.transform(found, lambda m: F.struct(*[F.regexp_extract(m, inner, k).alias(g) for k, g in ((1, "a"), (2, "b"), (3, "c"))]))
    dates = F.transform(groups, lambda g: date(g["a"], g["b"], g["c"]))
    return F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1))


def extract_date(text: Column, currency: Column) -> Column:
    """ISO, then day and month name, then month name and day, then numbers: day first, in dollars month first, the other order
    if that is impossible. The first valid date of the first of these that has one; null without."""
    currency = F.when(F.coalesce(currency, F.lit("")) != "", currency).otherwise(detect_currency(text, "IDR"))
    n = lambda x: F.translate(x, _DIGITS, "0123456789" * (len(_DIGITS) // 10)).try_cast("int")

    def find(x):
        def numeric(a, b, y):
            day_first, month_first = valid_date(n(y), n(b), n(a)), valid_date(n(y), n(a), n(b))
            return F.when(x["currency"] == "USD", F.coalesce(month_first, day_first)).otherwise(F.coalesce(day_first, month_first))

        return F.coalesce(
            _first(x["text"], fixed.ISO_DATE, lambda y, m, d: valid_date(n(y), n(m), n(d))),
            _first(x["text"], fixed.DAY_NAME_DATE.replace("MONTH", _NAMES), lambda d, m, y: valid_date(n(y), month_number(m), n(d))),
            _first(x["text"], fixed.NAME_DAY_DATE.replace("MONTH", _NAMES), lambda m, d, y: valid_date(n(y), month_number(m), n(d))),
            _first(x["text"], fixed.NUMERIC_DATE, numeric),
        )

    return let(F.struct(text.alias("text"), currency.alias("currency")), find)


#: Written orders that a form accepts, in this order; '%b' names of three letters, '%B' whole ones.
INPUT_ORDERS = ["Y-m-d", "d/m/Y", "d-m-Y", "d.m.Y", "Y/m/d", "d/m/y", "d-m-y"]
MONTH_FIRST_ORDERS = ["m/d/Y", "m-d-Y", "m/d/y"]
_ENGLISH = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _by_order(raw: Column, order: str) -> Column:
    parts = {"Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})"}
    pattern = "^" + "".join(parts.get(c, "\\" + c) for c in order) + "$"
    letters = [c for c in order if c in parts]
    at = {c.lower(): F.regexp_extract(raw, pattern, k + 1).try_cast("int") for k, c in enumerate(letters)}
    year = F.when(at["y"] < 69, at["y"] + 2000).otherwise(at["y"] + 1900) if "y" in order else at["y"]
    iso = F.format_string("%04d-%02d-%02d", year, at["m"], at["d"])
    return F.when(F.regexp_like(raw, F.lit(pattern)) & (year > 0), F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))


def parse_date_input(raw: Column, currency: Column) -> Column:
    """A whole date as someone writes it, as ISO, else null; numbers are day first, in dollars month first where possible."""
    raw = F.trim(F.coalesce(raw, F.lit("")))
    usual = [_by_order(raw, o) for o in INPUT_ORDERS]
    dollars = [usual[0], *[_by_order(raw, o) for o in MONTH_FIRST_ORDERS], *usual[1:]]
    names = "|".join([*_ENGLISH, *[m[:3] for m in _ENGLISH]])
    pattern = rf"^((?i:{names}))\s+(\d{{1,2}}),?\s+(\d{{4}})$"
    number = F.element_at(F.create_map(*[F.lit(x) for k, m in enumerate(_ENGLISH) for x in (m[:3], k + 1)]), F.left(F.lower(F.regexp_extract(raw, pattern, 1)), F.lit(3)))
    iso = F.format_string("%04d-%02d-%02d", F.regexp_extract(raw, pattern, 3).try_cast("int"), number, F.regexp_extract(raw, pattern, 2).try_cast("int"))
    named = F.when(F.regexp_like(raw, F.lit(pattern)), F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))
    return F.coalesce(F.when(currency == "USD", F.coalesce(*dollars)).otherwise(F.coalesce(*usual)), named)


def presets(today: Column) -> dict[str, tuple[Column, Column]]:
    """Named ranges as ISO pairs."""
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    month = F.trunc(today, "month")
    return {"This month": (iso(month), iso(today)), "Last month": (iso(F.add_months(month, -1)), iso(F.date_sub(month, 1))), "This year": (iso(F.trunc(today, "year")), iso(today))}
