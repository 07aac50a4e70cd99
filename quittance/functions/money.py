"""Amounts in text, as native column expressions: currency marks, numbers of either notation, totals, cents, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

MONEY_TYPE = "decimal(38,2)"


def lines_of(text: Column) -> Column:
    return F.split(text, fixed.LINE_ENDS)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, wherever and however often body uses it."""
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def detect_currency(text: Column, default: Column | str = "") -> Column:
    """'USD' or 'IDR', whichever is marked more often, else the default. Null text has no marks."""
    default = F.lit(default) if isinstance(default, str) else default
    usd, idr = (F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for p in (fixed.USD_MARK, fixed.IDR_MARK))
    return F.when(usd > idr, "USD").when(idr > usd, "IDR").otherwise(default)


def parse_number(raw: Column) -> Column:
    """One or two digits behind the last separator are a fraction, all other separators group; the sign is lost. Null without
    a digit."""
    clean = F.regexp_replace(raw, "[^0-9.,]", "")
    tail = F.regexp_extract(clean, r"[.,]([0-9]{1,2})$", 1)
    digits = F.regexp_replace(clean, "[.,]", "")
    head = F.regexp_replace(F.regexp_replace(clean, r"[.,][0-9]{1,2}$", ""), "[.,]", "")
    number = F.when(tail != "", F.concat(F.when(head == "", "0").otherwise(head), F.lit("."), tail)).otherwise(digits)
    return F.when(digits != "", number.try_cast(MONEY_TYPE))


def money_tokens(line: Column, shaped: bool = False) -> Column:
    """array<struct<token, value>> of the positive numbers of a line. shaped leaves out what no amount looks like: over 6
    digits without a separator, over 12 digits."""
    found = F.transform(F.regexp_extract_all(line, F.lit(fixed.MONEY), F.lit(0)), lambda t: F.struct(t.alias("token"), parse_number(t).alias("value")))
    found = F.filter(found, lambda x: x["value"] > 0)
    if shaped:
        size = lambda x: F.length(F.regexp_replace(x["token"], "[.,]", ""))
        found = F.filter(found, lambda x: (size(x) <= 12) & ((size(x) <= 6) | (size(x) < F.length(x["token"]))))
    return found


def line_amounts(line: Column, currency: Column) -> Column:
    """Values that can be amounts: in dollars those with cents or on a line that names dollars, else those of 100 and more."""
    named = F.regexp_like(line, F.lit(fixed.USD_MARK))
    fits = lambda x: F.when(currency == "USD", named | F.regexp_like(x["token"], F.lit(r"[.,]\d{1,2}$"))).otherwise(x["value"] >= fixed.IDR_FLOOR)
    return F.transform(F.filter(money_tokens(line, True), fits), lambda x: x["value"].cast("decimal(16,2)"))


def _tier(lowered: Column) -> Column:
    """Tier of the longest total word of a line, the first listed on ties, 0 without one."""
    words = sorted(((len(w), -k, t, w) for k, (t, w) in enumerate((t, w) for t, ws in fixed.TOTAL_WORDS.items() for w in ws)), reverse=True)
    tier = F.lit(0)
    for *_, t, w in reversed(words):
        tier = F.when(F.contains(lowered, F.lit(w)), t).otherwise(tier)
    return tier


def extract_amount(text: Column, currency: Column) -> Column:
    """The total of a receipt as decimal(16,2): the largest amount of the highest tier of labelled lines; an unlabelled one that
    is larger by half at most beats it; without a label the largest of all. An empty currency is detected, else IDR."""
    currency = F.when(F.coalesce(currency, F.lit("")) != "", currency).otherwise(detect_currency(text, "IDR"))

    def total(x):
        lines = F.transform(lines_of(x["text"]), lambda y: F.struct(y.alias("line"), F.trim(F.lower(y)).alias("low")))
        lines = F.filter(lines, lambda y: (y["low"] != "") & ~contains_any(y["low"], fixed.NOT_TOTAL))
        found = F.transform(lines, lambda y: F.struct(_tier(y["low"]).alias("tier"), F.array_max(line_amounts(y["line"], x["currency"])).alias("value")))
        return let(F.filter(found, lambda y: y["value"].isNotNull()), lambda f: let(F.struct(labelled(f).alias("best"), unlabelled(f).alias("other")), choose))

    labelled = lambda f: F.array_max(F.filter(f, lambda y: y["tier"] > 0))["value"]
    unlabelled = lambda f: F.array_max(F.transform(F.filter(f, lambda y: y["tier"] == 0), lambda y: y["value"]))

    def choose(x):
        beats = (x["other"] > x["best"]) & (x["other"] <= x["best"] * F.lit(fixed.OVERRIDE).cast("decimal(2,1)"))
        return F.when(x["best"].isNull() | beats, x["other"]).otherwise(x["best"])

    return let(F.struct(text.alias("text"), currency.alias("currency")), total)


def format_amount(value: Column) -> Column:
    """'' for null, no decimals for whole amounts, else two."""
    text = value.cast("decimal(20,2)").cast("string")
    return F.when(text.isNull(), "").otherwise(F.regexp_replace(text, r"\.00$", ""))


def cents(amount: Column) -> Column:
    """Whole cents, half up on the amount as printed; null if it isn't a finite number."""
    return F.round(amount.cast("string").try_cast("decimal(38,18)") * 100, 0).cast("decimal(38,0)").try_cast("long")


def plain_money(amount: Column) -> Column:
    """Two decimals, without grouping."""
    return F.call_function("format_number", amount.cast("double"), F.lit("0.00"))


def format_money(amount: Column, currency: Column) -> Column:
    """'IDR 44,000', 'USD 56.48': whole amounts without decimals."""
    text = F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(F.format_number(amount, 2))
    return F.trim(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), text))
