"""Receipt-shaped inputs derived from the star schema, event and document tables; the same derivations in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Columns of the receipts view; {iso} is the date's text.
_RECEIPTS = [
    ("id", "o_orderkey"),
    ("name", "case o_orderkey % 4 when 0 then upper(c_name) when 1 then c_name when 2 then concat('  ', c_name, ' ') else replace(c_name, '#', ' # ') end"),
    ("amount", "o_totalprice"),
    ("entry_date", "case when o_orderkey % 29 = 0 then '' when o_orderkey % 31 = 0 then null else {iso} end"),
    ("currency", "case left(o_orderpriority, 1) when '1' then 'IDR' when '2' then 'USD' when '3' then null when '4' then '' else 'IDR' end"),
    ("category", "c_mktsegment"),
    ("notes", "case o_orderkey % 3 when 0 then concat('note ', o_orderkey) when 1 then ' ' end"),
    ("email_message_id", "case when o_orderkey % 7 < 2 then concat('<', o_custkey % 500, '@mail>') end"),
    ("source_sha256", "case when o_orderkey % 7 >= 2 then md5(cast(o_orderkey % 4000 as {text})) end"),
    ("scanned_path", "case when o_orderkey % 5 < 3 then concat('scan/', o_orderkey, '.png') end"),
    ("source_path", "case when o_orderkey % 7 < 2 then concat('mail/', o_custkey % 20, '.mbox') else concat('photo/', o_orderkey, '.jpg') end"),
]


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.selectExpr(*[f"{e.format(iso='date_format(o_orderdate, {q}yyyy-MM-dd{q})'.format(q=chr(39)), text='string')} as {c}" for c, e in _RECEIPTS])


RECEIPTS = "receipts as (select " + ", ".join(f"{e.format(iso='strftime(o_orderdate, {q}%Y-%m-%d{q})'.format(q=chr(39)), text='varchar')} as {c}" for c, e in _RECEIPTS) + " from orders join customer on o_custkey = c_custkey)"


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose keys repeat: amounts in steps of 100,000, dates by month."""
    rows = receipts(spark, sf_dir)
    return rows.withColumn("amount", F.floor(F.col("amount") / 100000) * 100000.0).withColumn("entry_date", F.when(F.col("entry_date") != "", F.concat(F.left("entry_date", F.lit(7)), F.lit("-01"))))


COARSE = RECEIPTS + ", coarse as (select * replace (floor(amount / 100000) * 100000.0 as amount, case when entry_date <> '' then left(entry_date, 7) || '-01' end as entry_date) from receipts)"

_RAW = "case when id % 37 = 0 then 'abc' when id % 41 = 0 then '' when id % 43 = 0 then null when id % 47 = 0 then '1500' else cast(cast(amount as decimal(18,2)) as {text}) end"


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with amounts as text, some of them unreadable."""
    return receipts(spark, sf_dir).withColumn("amount", F.expr(_RAW.format(text="string")))


RAW = RECEIPTS + f", raw_rows as (select * replace ({_RAW.format(text='varchar')} as amount) from receipts)"

_LINE = "concat(p_name, ' ', cast(l_quantity as {int}), ' x ', cast(floor(p_retailprice) as {int}))"


def receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One printed receipt per order: header, address, date in one of six styles, lines, totals in rupiah or dollars."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.expr(_LINE.format(int="int")).alias("line"))
    body = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n").alias("body"))
    rows = read(spark, sf_dir, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    iso = lambda f: f"date_format(o_orderdate, '{f}')"
    date = f"case o_orderkey % 6 when 0 then {iso('yyyy-MM-dd')} when 1 then {iso('dd/MM/yyyy')} when 2 then {iso('dd MMMM yyyy')} when 3 then {iso('MMM d, yyyy')} when 4 then {iso('MM-dd-yy')} else 'tanpa tanggal' end"
    total = "case when o_orderkey % 5 < 3 then concat('Rp ', replace(format_number(cast(floor(o_totalprice) as bigint), 0), ',', '.')) else concat('$', format_number(o_totalprice, 2)) end"
    text = f"concat(upper(case o_orderkey % 4 when 0 then 'Toko Maju Jaya' when 1 then 'Warung Kopi Senja' when 2 then 'Apotek Sehat' else 'Shell Station' end), '\\n', 'Jl. Mangga No. 5', '\\n', {date}, '\\n', body, '\\n', 'Subtotal 1.000', '\\n', case o_orderkey % 3 when 0 then 'Grand Total ' when 1 then 'TOTAL ' else 'Irand Tolal ' end, {total}, '\\n', 'Kembali 999.000', '\\n', 'Ref 1234567890123')"
    return rows.select(F.col("o_orderkey").alias("id"), F.expr(text).alias("text"))


_M = "strftime(o_orderdate, '%B')"
TEXTS = (
    "bodies as (select l_orderkey, string_agg(line, chr(10) order by l_linenumber, line) as body from (select l_orderkey, l_linenumber, " + _LINE.format(int="int")
    + " as line from lineitem join part on l_partkey = p_partkey) group by 1), texts as (select o_orderkey as id, concat(upper(case o_orderkey % 4 when 0 then 'Toko Maju Jaya' when 1 then 'Warung Kopi Senja' when 2 then 'Apotek Sehat' else 'Shell Station' end), chr(10), 'Jl. Mangga No. 5', chr(10), "
    "case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then strftime(o_orderdate, '%d %B %Y') when 3 then strftime(o_orderdate, '%b %-d, %Y') when 4 then strftime(o_orderdate, '%m-%d-%y') else 'tanpa tanggal' end, "
    "chr(10), body, chr(10), 'Subtotal 1.000', chr(10), case o_orderkey % 3 when 0 then 'Grand Total ' when 1 then 'TOTAL ' else 'Irand Tolal ' end, "
    "case when o_orderkey % 5 < 3 then concat('Rp ', replace(format('{:,}', cast(floor(o_totalprice) as bigint)), ',', '.')) else concat('$', format('{:,.2f}', o_totalprice)) end, chr(10), 'Kembali 999.000', chr(10), 'Ref 1234567890123') as text "
    "from orders join bodies on o_orderkey = l_orderkey)"
)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as recognised boxes; every seventh conf is -1."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_num", "line"))
    found = lines.select("doc", "line_num", F.posexplode(F.split("line", " ")).alias("word_num", "text"))
    conf = F.expr("case when (doc + 3 * line_num + word_num) % 7 = 0 then -1 else (doc * 31 + line_num * 17 + word_num * 13) % 101 end")
    return found.select("doc", "text", conf.alias("conf"), F.lit(1).alias("page_num"), (F.col("line_num") % 3).alias("block_num"), F.lit(1).alias("par_num"), "line_num", "word_num")


WORDS = """lines as (select doc_id as doc, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_num from documents),
boxes as (select doc, line_num, unnest(string_split(line, ' ')) as text, generate_subscripts(string_split(line, ' '), 1) - 1 as word_num from lines),
words as (select *, case when (doc + 3 * line_num + word_num) % 7 = 0 then -1 else (doc * 31 + line_num * 17 + word_num * 13) % 101 end as conf, line_num % 3 as block_num from boxes)"""


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a queue's log: users are items, kinds of events are steps."""
    step = "case event_type when 'click' then 'begin' when 'view' then 'stage' when 'purchase' then 'done' when 'error' then 'failed' else 'saved' end"
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.expr(step).alias("event"))


EVENTS = "steps as (select user_id as item, event_id as seq, case event_type when 'click' then 'begin' when 'view' then 'stage' when 'purchase' then 'done' when 'error' then 'failed' else 'saved' end as event from events)"


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: body has all turns whole; body_text is empty in every fifth message, so that some are skipped."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = lambda x: F.when(x["role"] == "assistant", F.concat(F.lit("Toko: "), x["text"])).otherwise(x["text"])
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, said), "\n").alias("body"))
    return rows.select(F.col("conv_id").alias("id"), "body", F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("body")).alias("body_text"), F.when(F.col("conv_id") % 5 == 1, "<p>x</p>").otherwise("").alias("body_html"), (F.col("conv_id") % 4).cast("int").alias("n_images"))


MAILS = """bodies as (select conv_id, string_agg(case when role = 'assistant' then 'Toko: ' || text else text end, chr(10) order by turn, role, text) as body from conversations group by 1),
mails as (select conv_id as id, case when conv_id % 5 = 0 then '' else body end as body_text, case when conv_id % 5 = 1 then '<p>x</p>' else '' end as body_html, cast(conv_id % 4 as int) as n_images from bodies)"""


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes of report entries, a report per supplier."""
    return read(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "cast(l_quantity * 60 as bigint) as width", "cast(floor(l_extendedprice / 7) % 20000 + 50 as bigint) as height")


GEOMETRY = "geometry as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, cast(l_quantity * 60 as bigint) as width, cast(floor(l_extendedprice / 7) % 20000 + 50 as bigint) as height from lineitem)"
