"""Queries over the bridge views, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, fixed, money, names
from .functions.receipt import parse_receipt
from .operators import ledger, mail, report, words
from .plans import bridge
from .sources.html import html_rows, rows_to_text
from .streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CATEGORIES = [*fixed.CATEGORY_WORDS, fixed.OTHER_CATEGORY]
START, END = "1996-03-01", "1997-06-30"

#: Fixed recipe: marks of a currency in s, counted by position, for an SQL without lookbehind.
_USD = r"len(list_filter(generate_series(1, length({s})), lambda p: (regexp_matches(substr({s}, p, 8), '^(?i:US\$|USD(?:[^A-Za-z]|$))') and not regexp_matches(substr(' ' || {s}, p, 1), '[A-Za-z]')) or (regexp_matches(substr({s}, p, 8), '^\$\s?[0-9]') and not regexp_matches(substr(' ' || {s}, p, 1), '[A-Za-z$]'))))"
_IDR = r"len(list_filter(generate_series(1, length({s})), lambda p: regexp_matches(substr({s}, p, 8), '^(?i:Rp|IDR|rupiah)(?:[^A-Za-z]|$)') and not regexp_matches(substr(' ' || {s}, p, 1), '[A-Za-z]')))"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _sql_number(t: str) -> str:
    """The value of a money token in SQL."""
    return f"case when regexp_matches({t}, '[.,][0-9]{{1,2}}$') then try_cast(concat(coalesce(nullif(regexp_replace(regexp_replace({t}, '[.,][0-9]{{1,2}}$', ''), '[.,]', '', 'g'), ''), '0'), '.', regexp_extract({t}, '[.,]([0-9]{{1,2}})$', 1)) as decimal(38,2)) else try_cast(regexp_replace({t}, '[.,]', '', 'g') as decimal(38,2)) end"


_KEY = "trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as k_title, cast(round(cast(cast(amount as varchar) as decimal(38,10)) * 100, 0) as bigint) as k_cents, upper(trim(coalesce(currency, ''))) as k_currency, trim(entry_date) as k_date"
_KEYED = f"keyed as (select *, {_KEY} from coarse), good as (select * from keyed where k_title <> '' and k_cents is not null and coalesce(k_date, '') <> '')"


# ranges, lookups, sums


@query(f"with {bridge.RECEIPTS} select id, name, amount, entry_date, currency, category from receipts where entry_date between '{START}' and '{END}' and entry_date <> ''")
def entries_between(spark, sf_dir):
    return ledger.entries_between(bridge.receipts(spark, sf_dir), END, START).select("id", "name", "amount", "entry_date", "currency", "category")


@query(f"with {bridge.RECEIPTS} select min(entry_date) as first, max(entry_date) as last from receipts where entry_date <> ''")
def date_bounds(spark, sf_dir):
    return ledger.date_bounds(bridge.receipts(spark, sf_dir))


@query(f"with {bridge.RECEIPTS} select id, name, amount, entry_date from receipts order by id desc limit 200")
def recent(spark, sf_dir):
    return ledger.recent(bridge.receipts(spark, sf_dir)).select("id", "name", "amount", "entry_date")


@query(f"with {bridge.RECEIPTS} select source_sha256, max(id) as id from receipts where source_sha256 <> '' group by 1")
def find_by_hash(spark, sf_dir):
    rows = bridge.receipts(spark, sf_dir)
    return ledger.latest_by(rows, "source_sha256", rows.select("source_sha256").where("source_sha256 <> ''").distinct())


@query(f"with {bridge.RECEIPTS} select email_message_id, max(id) as id from receipts where email_message_id <> '' group by 1")
def find_by_message_id(spark, sf_dir):
    rows = bridge.receipts(spark, sf_dir)
    return ledger.latest_by(rows, "email_message_id", rows.select("email_message_id").where("email_message_id <> ''").distinct())


@query(f"with {bridge.RECEIPTS} select coalesce(currency, '') as currency, count(*) as entries, cast(sum(cast(amount as decimal(18,2))) as double) as total from receipts group by 1")
def summary_by_currency(spark, sf_dir):
    return ledger.summary(bridge.receipts(spark, sf_dir))


_SUMS = f"ranged as (select * from raw_rows where entry_date between '{START}' and '{END}' and entry_date <> ''), read as (select coalesce(nullif(currency, ''), 'IDR') as currency, cast(try_cast(coalesce(nullif(trim(amount), ''), '0') as double) as decimal(18,2)) as value from ranged), sums as (select currency, count(*) as entries, cast(sum(value) as double) as total from read where value is not null group by 1)"


@query(f"with {bridge.RAW}, {_SUMS} select *, (select count(*) from ranged) as all_entries from sums")
def report_summary(spark, sf_dir):
    return report.summarize(ledger.entries_between(bridge.raw_rows(spark, sf_dir), START, END), "IDR")


@query(f"with {bridge.RAW}, {_SUMS} select string_agg(currency || ' ' || case when total = floor(total) then format('{{:,.0f}}', cast(total as double)) else format('{{:,.2f}}', cast(total as double)) end, ' · ' order by currency) as totals from sums")
def format_totals(spark, sf_dir):
    return report.format_totals(report.summarize(ledger.entries_between(bridge.raw_rows(spark, sf_dir), START, END), "IDR"))


_AMOUNT = "coalesce(printf('%.2f', try_cast(coalesce(nullif(trim(amount), ''), '0') as double)), '')"


@query(f"with {bridge.RAW} select id, coalesce(entry_date, '') as date, coalesce(category, '') as category, coalesce(name, '') as expense_detail, {_AMOUNT} as amount, coalesce(nullif(currency, ''), 'IDR') as currency from raw_rows")
def csv_projection(spark, sf_dir):
    return report.csv_rows(bridge.raw_rows(spark, sf_dir), "IDR")


@query(f"with {bridge.RAW} select id, coalesce(entry_date, '') as date, coalesce(category, '') as category, trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g')) as detail, coalesce(coalesce(nullif(currency, ''), 'IDR') || ' ' || case when v = floor(v) then format('{{:,.0f}}', v) else format('{{:,.2f}}', v) end, '') as amount from (select *, try_cast(trim(amount) as double) as v from raw_rows)")
def index_rows(spark, sf_dir):
    return report.index_entries(bridge.raw_rows(spark, sf_dir), "IDR")


# keys, duplicates, upserts


@query(f"with {bridge.RECEIPTS} select id, cast(round(cast(cast(amount as varchar) as decimal(38,10)) * 100, 0) as bigint) as cents from receipts")
def cents(spark, sf_dir):
    return bridge.receipts(spark, sf_dir).select("id", money.cents(F.col("amount")).alias("cents"))


@query(f"with {bridge.COARSE}, {_KEYED} select id, case when k_title <> '' and k_cents is not null and coalesce(k_date, '') <> '' then '[\"' || k_title || '\",' || k_cents || ',\"' || k_currency || '\",\"' || k_date || '\"]' end as dedupe_key from keyed")
def dedupe_key(spark, sf_dir):
    return bridge.coarse(spark, sf_dir).select("id", ledger.key_text(ledger.key_parts()).alias("dedupe_key"))


_SURVIVORS = "survivors as (select *, row_number() over (partition by k_title, k_cents, k_currency, k_date order by id) as r, first_value(case when trim(coalesce(notes, '')) <> '' then notes end ignore nulls) over (partition by k_title, k_cents, k_currency, k_date order by id rows between unbounded preceding and unbounded following) as noted from good)"


@query(f"with {bridge.COARSE}, {_KEYED}, {_SURVIVORS} select id, name, case when trim(coalesce(notes, '')) <> '' then notes else coalesce(noted, notes) end as notes from survivors where r = 1 union all select id, name, notes from keyed where id not in (select id from good)")
def collapse_duplicates(spark, sf_dir):
    return ledger.collapse_duplicates(bridge.coarse(spark, sf_dir)).select("id", "name", "notes")


@query(f"with {bridge.COARSE}, {_KEYED} select '[\"' || k_title || '\",' || k_cents || ',\"' || k_currency || '\",\"' || k_date || '\"]' as dedupe_key, count(*) as entries from good group by all having count(*) > 1")
def unique_violations(spark, sf_dir):
    return ledger.unique_violations(bridge.coarse(spark, sf_dir))


_UPSERT = (
    "every as (select *, id as seq from keyed), marked as (select *, k_title <> '' and k_cents is not null and coalesce(k_date, '') <> '' as ok from every), "
    "folded as (select min(seq) as first, min(seq) as created, max(seq) as updated, arg_max(name, seq) as name, arg_max(category, seq) as category, "
    "coalesce(arg_max(notes, seq) filter (trim(coalesce(notes, '')) <> ''), arg_min(coalesce(notes, chr(1)), seq)) as notes from marked where ok group by k_title, k_cents, k_currency, k_date "
    "union all select seq, seq, seq, name, category, coalesce(notes, chr(1)) from marked where not coalesce(ok, false)) "
)


@query(f"with {bridge.COARSE}, {_KEYED}, {_UPSERT} select row_number() over (order by first) as id, cast(created as varchar) as created_at, cast(updated as varchar) as updated_at, name, category, nullif(notes, chr(1)) as notes from folded")
def upsert_fold(spark, sf_dir):
    events = bridge.coarse(spark, sf_dir).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("at"), "name", "amount", "entry_date", "currency", "category", "notes")
    empty = events.where("false").select(F.lit(0).cast("long").alias("id"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), *events.columns[2:])
    return ledger.upsert(empty, events).select("id", "created_at", "updated_at", "name", "category", "notes")


@query(f"with {bridge.COARSE} select count(*) as entries, count(source_kind) as kinds, count(ocr_text) as texts, count(distinct name) as names from (select 'image' as source_kind, cast(null as varchar) as ocr_text, * from receipts)")
def schema_upgrade(spark, sf_dir):
    rows = ledger.conform(bridge.receipts(spark, sf_dir).select("id", "name", "amount", "entry_date"))
    return rows.agg(F.count("*").alias("entries"), F.count("source_kind").alias("kinds"), F.count("ocr_text").alias("texts"), F.countDistinct("name").alias("names"))


@query(f"with {bridge.RECEIPTS} select id, name from receipts where id not in (select o_orderkey from orders where o_orderstatus = 'F')")
def delete_entries(spark, sf_dir):
    gone = bridge.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return ledger.delete_entries(bridge.receipts(spark, sf_dir), gone).select("id", "name")


@query(f"with {bridge.RECEIPTS}, h as (select source_sha256 as k, max(id) as id from receipts where source_sha256 <> '' group by 1), m as (select email_message_id as k, max(id) as id from receipts where email_message_id <> '' group by 1) select e.event_id as item, case when e.event_id % 3 = 0 then h.id else m.id end as entry_id from events e left join h on e.event_id % 3 = 0 and h.k = md5(cast(e.event_id % 5000 as varchar)) left join m on e.event_id % 3 <> 0 and m.k = concat('<', e.event_id % 700, '@mail>')")
def duplicate_warning(spark, sf_dir):
    items = bridge.read(spark, sf_dir, "events").selectExpr("event_id as item", "case when event_id % 3 = 0 then md5(cast(event_id % 5000 as string)) end as source_sha256", "case when event_id % 3 <> 0 then concat('<', event_id % 700, '@mail>') end as email_message_id")
    return ledger.duplicate_warning(items, bridge.receipts(spark, sf_dir))


@query("select distinct 'photo/' || o_custkey || '.jpg' as path from orders where 'photo/' || o_custkey || '.jpg' not in (select 'photo/' || c_custkey || '.jpg' from customer where c_acctbal < 0)")
def not_yet_queued(spark, sf_dir):
    paths = bridge.read(spark, sf_dir, "orders").selectExpr("concat('photo/', o_custkey, '.jpg') as path")
    return ledger.not_yet_queued(paths, bridge.read(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("concat('photo/', c_custkey, '.jpg') as path"))


# reports


@query(f"with {bridge.RECEIPTS} select id, category, row_number() over (partition by category order by entry_date nulls first, id) as number, cast(floor((row_number() over (partition by category order by entry_date nulls first, id) - 1) / 38) + 1 as bigint) as index_page from receipts")
def entry_numbers(spark, sf_dir):
    rows = bridge.receipts(spark, sf_dir).select("id", "category", "entry_date", F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"))
    return report.page_numbers(rows, ["category"], ["entry_date", "id"]).select("id", "category", "number", "index_page")


_PAGES = "sized as (select *, least(1.0::double, 1494 / width::double) as ws, least(1.0::double, 1989 / height::double) as fs from geometry), tall as (select *, case when ws = 1 then height else greatest(1, cast(round_even(height * ws, 0) as bigint)) end as t from sized), paged as (select *, cast(case when fs >= 0.6 * ws or t <= 1989 then 1 else 2 + ceil(greatest(0, t - 4038) / 2049) end as bigint) as pages from tall)"


@query(f"with {bridge.GEOMETRY}, {_PAGES} select l_suppkey, l_orderkey, l_linenumber, l_partkey, pages, row_number() over w as number, cast(greatest(1, ceil(count(*) over (partition by l_suppkey) / 38)) + 1 + coalesce(sum(pages) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, width, height rows between unbounded preceding and 1 preceding), 0) as bigint) as page from paged window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, width, height)")
def page_numbers(spark, sf_dir):
    rows = report.page_numbers(bridge.geometry(spark, sf_dir), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "width", "height"])
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "pages", "number", "page")


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as b, row_number() over (partition by user_id order by event_id) as n from events) where n = 1 or event_type is distinct from b")
def consecutive_dedupe(spark, sf_dir):
    return report.drop_repeats(bridge.read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").select("event_id", "user_id", "event_type")


_FILES = "files as (select 'scan/' || o_orderkey || '.png' as path from orders where o_orderstatus <> 'P' union select 'mail/' || n || '.mbox' from range(0, 15) t(n) union select 'photo/' || o_orderkey || '.jpg' from orders where o_totalprice > 100000)"


@query(f"with {bridge.RECEIPTS}, {_FILES}, marked as (select case when scanned_path in (select path from files) then 'scan' when source_path in (select path from files) then case when source_path like '%.mbox' then case when coalesce(email_message_id, '') <> '' then 'redrawn' else 'none' end else 'original' end else 'none' end as origin from receipts) select origin, count(*) as entries from marked group by 1")
def origin_counts(spark, sf_dir):
    orders = bridge.read(spark, sf_dir, "orders")
    files = orders.where("o_orderstatus <> 'P'").selectExpr("concat('scan/', o_orderkey, '.png') as path").union(spark.range(15).selectExpr("concat('mail/', id, '.mbox')")).union(orders.where("o_totalprice > 100000").selectExpr("concat('photo/', o_orderkey, '.jpg')"))
    return report.expected_origin(bridge.receipts(spark, sf_dir), files).groupBy("origin").agg(F.count("*").alias("entries"))


@query(f"with {bridge.RECEIPTS}, boxes as (select concat('mail/', c_custkey % 20, '.mbox') as source_path, trim(concat(' <', c_custkey % 500, '@mail> ')) as k, min(c_custkey) as message_index from customer group by 1, 2) select r.id, b.message_index from receipts r left join boxes b on r.source_path = b.source_path and trim(r.email_message_id) = b.k")
def mail_lookup(spark, sf_dir):
    messages = bridge.read(spark, sf_dir, "customer").selectExpr("concat('mail/', c_custkey % 20, '.mbox') as mbox_path", "concat(' <', c_custkey % 500, '@mail> ') as message_id", "c_custkey as index")
    return report.message_lookup(bridge.receipts(spark, sf_dir).select("id", "source_path", "email_message_id"), messages)


# text to fields


@query(f"with {bridge.TEXTS}, counts as (select id, {_USD.format(s='text')} as usd, {_IDR.format(s='text')} as idr from texts) select id, case when usd > idr then 'USD' when idr > usd then 'IDR' else 'none' end as currency from counts")
def detect_currency(spark, sf_dir):
    return bridge.receipt_texts(spark, sf_dir).select("id", money.detect_currency(names.normalize(F.col("text")), "none").alias("currency"))


_TOKENS = f"tokens as (select id, line, unnest(regexp_extract_all(line, '[0-9][0-9.,]*[0-9]|[0-9]')) as token from (select id, unnest(string_split(text, chr(10))) as line from texts)), valued as (select *, {_sql_number('token')} as value, len(regexp_replace(token, '[.,]', '', 'g')) as digits from tokens)"


@query(f"with {bridge.TEXTS}, {_TOKENS} select id, count(*) as tokens, cast(sum(cast(value as decimal(28,2))) as double) as total from valued where value > 0 group by 1")
def parse_number(spark, sf_dir):
    rows = bridge.receipt_texts(spark, sf_dir).select("id", F.explode(money.money_tokens(F.col("text"))).alias("t"))
    return rows.groupBy("id").agg(F.count("*").alias("tokens"), F.sum(F.col("t.value").cast("decimal(28,2)")).cast("double").alias("total"))


@query(f"with {bridge.TEXTS}, {_TOKENS} select id, token, cast(value as varchar) as value, count(*) as n from valued where value > 0 and digits <= 12 and (digits <= 6 or digits < len(token)) group by all")
def money_tokens(spark, sf_dir):
    lines = bridge.receipt_texts(spark, sf_dir).select("id", F.explode(money.lines_of(F.col("text"))).alias("line"))
    return lines.select("id", F.inline(money.money_tokens(F.col("line"), True))).groupBy("id", "token", F.col("value").cast("string").alias("value")).agg(F.count("*").alias("n"))


def _sql_in(column: str, values: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in values) + ")"


_TIERS = "[" + ", ".join(f"{{'n': {len(w)}, 'k': -{k}, 't': {t}, 'w': '{w}'}}" for k, (t, w) in enumerate((t, w) for t, ws in fixed.TOTAL_WORDS.items() for w in ws)) + "]"
_LINES = (
    f"money as (select id, text, case when usd > idr then 'USD' else 'IDR' end as currency from (select id, text, {_USD.format(s='text')} as usd, {_IDR.format(s='text')} as idr from texts)), "
    "lined as (select id, currency, unnest(string_split(text, chr(10))) as line from money), "
    f"usable as (select *, lower(trim(line)) as low, row_number() over () as n from lined where trim(line) <> '' and not {_sql_in('lower(line)', fixed.NOT_TOTAL)}), "
    f"tiered as (select *, coalesce(list_sort(list_filter({_TIERS}, lambda x: contains(low, x.w)), 'DESC')[1].t, 0) as tier, {_USD.format(s='line')} > 0 as named from usable), "
    f"toks as (select *, unnest(regexp_extract_all(line, '[0-9][0-9.,]*[0-9]|[0-9]')) as token from tiered), "
    f"vals as (select *, {_sql_number('token')} as value, len(regexp_replace(token, '[.,]', '', 'g')) as digits from toks), "
    "fit as (select id, n, tier, max(value) as value from vals where value > 0 and digits <= 12 and (digits <= 6 or digits < len(token)) and case when currency = 'USD' then named or regexp_matches(token, '[.,][0-9]{1,2}$') else value >= 100 end group by all), "
    "best as (select id, max({'t': tier, 'v': value}) filter (tier > 0) as b, max(value) filter (tier = 0) as u from fit group by 1), "
    "amounts as (select id, case when b is null or (u > b.v and u <= b.v * 1.5) then u else b.v end as amount from best)"
)


@query(f"with {bridge.TEXTS}, {_LINES} select t.id, case when a.amount is null then '' when a.amount = floor(a.amount) then cast(cast(a.amount as bigint) as varchar) else cast(cast(a.amount as decimal(16,2)) as varchar) end as amount from texts t left join amounts a using (id)")
def extract_amount(spark, sf_dir):
    return bridge.receipt_texts(spark, sf_dir).select("id", money.format_amount(money.extract_amount(names.normalize(F.col("text")), F.lit(""))).alias("amount"))


@query(f"with {bridge.TEXTS}, {_LINES} select m.id, case o_orderkey % 6 when 5 then null when 3 then case when day(o_orderdate) >= 10 then '20' || strftime(o_orderdate, '%d') || '-' || strftime(o_orderdate, '%m') || '-05' else strftime(o_orderdate, '%Y-%m-%d') end when 1 then coalesce(case when m.currency = 'USD' and day(o_orderdate) <= 12 then strftime(o_orderdate, '%Y-%d-%m') end, strftime(o_orderdate, '%Y-%m-%d')) when 4 then coalesce(case when m.currency <> 'USD' and day(o_orderdate) <= 12 then strftime(o_orderdate, '%Y-%d-%m') end, strftime(o_orderdate, '%Y-%m-%d')) else strftime(o_orderdate, '%Y-%m-%d') end as entry_date from money m join orders on o_orderkey = m.id")
def extract_date(spark, sf_dir):
    """Matches cross lines: the 5 of the address before a line "Jul 25, 1997" makes 5 July 2025, as the rules say."""
    return bridge.receipt_texts(spark, sf_dir).select("id", dates.extract_date(names.normalize(F.col("text")), F.lit("")).alias("entry_date"))


_INPUT = "case o_orderkey % 5 when 0 then {a} when 1 then {b} when 2 then {c} when 3 then {d} else 'soon' end"


@query("select o_orderkey as id, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then case when o_orderkey % 2 = 0 and day(o_orderdate) <= 12 then strftime(o_orderdate, '%Y-%d-%m') else strftime(o_orderdate, '%Y-%m-%d') end when 2 then strftime(o_orderdate, '%Y-%m-%d') when 3 then strftime(o_orderdate, '%Y-%m-%d') end as entry_date from orders")
def parse_date_input(spark, sf_dir):
    d = lambda f: f"date_format(o_orderdate, '{f}')"
    rows = bridge.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_INPUT.format(a=d("yyyy-MM-dd"), b=d("dd/MM/yyyy"), c=d("dd.MM.yyyy"), d=d("MMMM d, yyyy"))).alias("raw"), F.expr("case when o_orderkey % 2 = 0 then 'USD' else 'IDR' end").alias("currency"))
    return rows.select("id", dates.parse_date_input(F.col("raw"), F.col("currency")).alias("entry_date"))


@query("select distinct strftime(o_orderdate, '%Y-%m-%d') as today, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month_start, strftime(date_trunc('month', o_orderdate) - interval 1 month, '%Y-%m-%d') as last_start, strftime(date_trunc('month', o_orderdate) - interval 1 day, '%Y-%m-%d') as last_end, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') as year_start from orders")
def presets(spark, sf_dir):
    days = bridge.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("today")).distinct()
    named = dates.presets(F.col("today"))
    return days.select(F.date_format("today", "yyyy-MM-dd").alias("today"), named["This month"][0].alias("month_start"), named["Last month"][0].alias("last_start"), named["Last month"][1].alias("last_end"), named["This year"][0].alias("year_start"))


_SCORES = ", ".join(f"{{'s': {' + '.join(f'case when contains(low, {chr(39)}{w}{chr(39)}) then {len(w)} else 0 end' for w in ws)}, 'k': -{k}, 'c': '{c}'}}" for k, (c, ws) in enumerate(fixed.CATEGORY_WORDS.items()))


@query(f"with {bridge.TEXTS}, scored as (select id, list_sort([{_SCORES}], 'DESC')[1] as b from (select id, lower(text) as low from texts)) select id, case when b.s > 0 then b.c else '{fixed.OTHER_CATEGORY}' end as category from scored")
def guess_category(spark, sf_dir):
    return bridge.receipt_texts(spark, sf_dir).select("id", names.guess_category(names.normalize(F.col("text")), CATEGORIES).alias("category"))


_NOISE = _sql_in("lower(line)", fixed.NOT_NAME)


@query(
    "with heads as (select doc_id, unnest(list_transform(string_split(text, chr(10))[1:10], lambda x, i: {'line': trim(x, ' *=-_|.,:''\"'), 'i': i - 1}), recursive := true) from documents), "
    "toked as (select *, list_filter(regexp_split_to_array(line, '\\s+'), lambda t: t <> '') as toks, len(regexp_replace(line, '[^\\p{L}]', '', 'g')) as letters from heads), "
    f"good as (select doc_id, line, (10 - i) * 5 + least(len(line), 40) + case when upper(line) = line and lower(line) <> line then 20 else 0 end as score from toked where len(line) >= 3 and not {_NOISE} and letters >= 3 and letters >= len(line) * 0.5 "
    "and not regexp_matches(lower(line), '\\b(jl|jalan|telp|tlp|phone|no\\.?\\s*[0-9])\\b') and len(list_filter(toks, lambda t: len(t) >= 4 and regexp_matches(t, '^\\p{L}+$'))) > 0 and len(list_filter(toks, lambda t: len(t) <= 2)) <= 0.4 * len(toks)), "
    "best as (select doc_id, max({'s': score, 'l': line}).l as line from good group by 1) select d.doc_id, left(b.line, 120) as name from documents d left join best b using (doc_id)"
)
def extract_name(spark, sf_dir):
    return bridge.read(spark, sf_dir, "documents").select("doc_id", names.extract_name(names.normalize(F.col("text"))).alias("name"))


@query()
def parse_receipts(spark, sf_dir):
    return bridge.receipt_texts(spark, sf_dir).select("id", parse_receipt(F.col("text"), CATEGORIES, "1990-01-01", "IDR").alias("r")).select("id", "r.*")


@query(f"with {bridge.RECEIPTS} select id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as title from receipts")
def title_normalised(spark, sf_dir):
    return bridge.receipts(spark, sf_dir).select("id", names.normalize_title(F.col("name")).alias("title"))


@query(f"with {bridge.RECEIPTS} select id, left(case when trim(regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g'), '._') = '' then 'attachment' else trim(regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g'), '._') end, 60) as safe from receipts")
def safe_names(spark, sf_dir):
    return bridge.receipts(spark, sf_dir).select("id", names.safe_name(F.col("name")).alias("safe"))


# words, mail, markup


@query(f"with {bridge.WORDS}, solid as (select * from words where trim(text) <> ''), ls as (select doc, block_num, line_num, string_agg(text, ' ' order by word_num, text) as t from solid group by 1, 2, 3), joined as (select doc, trim(string_agg(t, chr(10) order by block_num, line_num)) as text from ls group by 1), facts as (select doc, count(*) filter (trim(text) <> '') as word_count, coalesce(round(cast(sum(cast(conf as decimal(18,6))) filter (trim(text) <> '' and conf >= 0) as double) / nullif(count(*) filter (trim(text) <> '' and conf >= 0), 0), 2), 0.0) as mean_confidence from words group by 1) select f.doc, coalesce(j.text, '') as text, cast(f.mean_confidence as double) as mean_confidence, f.word_count from facts f left join joined j using (doc)")
def rebuild_text(spark, sf_dir):
    return words.rebuild_text(bridge.words(spark, sf_dir))


@query(f"with {bridge.MAILS} select id, case when n_images > 0 then 'images' when trim(body_html) = '' and trim(body_text) = '' then 'skip' else 'message' end as route from mails")
def mail_routing(spark, sf_dir):
    rows = bridge.mails(spark, sf_dir)
    images = F.array_repeat(F.lit("x"), F.col("n_images"))
    return rows.select("id", mail.route(images, F.col("body_html"), F.col("body_text")).alias("route"))


@query(f"with {bridge.MAILS} select route, count(*) as items from (select case when n_images > 0 then 'images' when trim(body_html) = '' and trim(body_text) = '' then 'skip' else 'message' end as route, unnest(generate_series(1, greatest(n_images, 1))) as k from mails) where route <> 'skip' group by 1")
def work_items(spark, sf_dir):
    rows = bridge.mails(spark, sf_dir).select(F.col("id").alias("index"), F.array_repeat(F.lit("x"), F.col("n_images")).alias("images"), "body_html", "body_text")
    return mail.work_items(rows).groupBy("route").agg(F.count("*").alias("items"))


@query()
def merchant_guess(spark, sf_dir):
    rows = bridge.mails(spark, sf_dir)
    return rows.select("id", names.merchant_guess(F.col("body"), F.concat(F.lit("Sender "), (F.col("id") % 9).cast("string")), F.lit("a@b")).alias("merchant"))


@query("select c_custkey as id, trim(concat('Toko ', c_mktsegment, ' ', c_nationkey), ' -–—,:') as trimmed from customer")
def trim_address(spark, sf_dir):
    rows = bridge.read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "concat('Toko ', c_mktsegment, '  ', c_nationkey, case c_custkey % 3 when 0 then ', Jakarta' when 1 then ' - Jl. Mangga No.9, RT.8' else '  Lantai 2' end) as raw")
    return rows.select("id", names.trim_address(F.col("raw")).alias("trimmed"))


@query()
def html_text(spark, sf_dir):
    rows = bridge.read(spark, sf_dir, "pages").select("page_id", html_rows("html").alias("rows"))
    return rows.select("page_id", F.size("rows").alias("n_rows"), F.sha2(rows_to_text(F.col("rows")), 256).alias("text_sha256"))


@query("select o_orderkey as id, case when o_orderkey % 11 = 0 then 'date required' when o_orderkey % 13 = 0 then 'invalid date' when o_orderkey % 17 = 0 then 'amount required' when o_orderkey % 19 = 0 then 'invalid amount' end as error, case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as entry_date from orders")
def validated_forms(spark, sf_dir):
    forms = bridge.read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "case when o_orderkey % 11 = 0 then ' ' when o_orderkey % 13 = 0 then 'soon' else date_format(o_orderdate, 'yyyy-MM-dd') end as raw_date",
        "case when o_orderkey % 17 = 0 then '' when o_orderkey % 19 = 0 then 'free' else cast(cast(o_totalprice as decimal(18,2)) as string) end as raw_amount", "'x' as name", "'' as category", "' usd' as currency", "'' as notes",
    )
    return mail.validated(forms).select("id", "error", "entry_date")


# the queue

_STATES = f"{bridge.EVENTS}, known as (select *, case event when 'begin' then 'Processing' when 'stage' then 'Processing' when 'done' then 'Needs review' when 'failed' then 'Failed' when 'saved' then 'Saved' end as state from steps), states as (select item, arg_max(state, seq) as state, count(*) as events from known group by 1)"


@query(f"with {_STATES} select * from states")
def queue_state(spark, sf_dir):
    return queue.queue_state(bridge.queue_events(spark, sf_dir))


@query(f"with {_STATES} select count(*) as total, count(*) filter (state = 'Saved') as saved, count(*) filter (state = 'Needs review') as to_review, count(*) filter (state = 'Failed') as failed from states")
def queue_counts(spark, sf_dir):
    return queue.queue_counts(queue.queue_state(bridge.queue_events(spark, sf_dir)))


@query(f"with {_STATES} select item, state from states where state in ('Queued', 'Failed')")
def retry_set(spark, sf_dir):
    return queue.startable(queue.queue_state(bridge.queue_events(spark, sf_dir))).select("item", "state")


@query(f"with {_STATES}, numbered as (select row_number() over (order by item) - 1 as item, state from states) select arg_min(item, (item - 5 + (select count(*) from states)) % (select count(*) from states)) as item from numbered where state = 'Needs review'")
def next_review(spark, sf_dir):
    from pyspark.sql import Window

    states = queue.queue_state(bridge.queue_events(spark, sf_dir))
    return queue.next_review(states.select((F.row_number().over(Window.orderBy("item")) - 1).cast("long").alias("item"), "state"), 4)
