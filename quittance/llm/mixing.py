"""Mixing sources to target weights by hash thresholds: DataFrame operations only.

Each document has a fixed hash of its id. Words are summed by source and hash prefix; the running sum shows the prefix in
which a source's budget ends, and only that prefix is summed again by longer prefixes. The result is one threshold per
source, so taking documents is a filter: nothing is sorted by document. Whole documents are taken, each 0, 1 or 2 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, unnamed, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, and the most of a source, as multiples of its size.
SHARE, MOST = 1.5, 2
#: Hexadecimal digits of the hash at each refinement; the last leaves about one document of 10**10 in a prefix.
LEVELS = (3, 6, 9)


def mix_hash(doc_id: Column, text: Column) -> Column:
    """Nine hexadecimal digits, fixed for a document; rows without an id hash their text."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), text), F.lit(""))), 1, LEVELS[-1])


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size). Adds target: SHARE of all sizes by weight, at most MOST times a source's size; the excess
    is shared again by weight. One row per source passes through one window."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("w", weight).withColumn("ratio", MOST * F.col("source_size") / F.col("w"))
    every, before = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # twice the sizes, so that one and a half of them are whole numbers
    left = F.sum(F.col("source_size") * int(2 * SHARE)).over(every) - F.coalesce(F.sum(2 * MOST * F.col("source_size")).over(before), F.lit(0))
    weights = 2 * (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("left", left).withColumn("weights", weights).withColumn("free", F.col("ratio") > F.col("left") / F.col("weights"))
    first = F.min(F.when(F.col("free"), F.struct("ratio", F.col("source").isNull(), "source", "left", "weights"))).over(every)
    rows = rows.withColumn("at", first)
    return rows.select("source", "source_size", F.when(F.col("free"), F.col("w") * F.col("at.left") / F.col("at.weights")).otherwise((MOST * F.col("source_size")).cast("double")).alias("target"))


def mix_plan(sized: DataFrame) -> DataFrame:
    """sized: (source, size, h). One row per source: source_size, target, whole (copies of every document), cut (hash prefix
    below which documents are taken once more), edge (whether the documents at the cut are, too)."""
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    bound = plan.select("source", "rest", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    for digits in LEVELS:
        b = bound.withColumnRenamed("source", "b_source")
        held = sized.where("size > 0").join(b, F.col("source").eqNullSafe(F.col("b_source")) & F.col("h").startswith(F.col("cut")))
        sums = held.groupBy("source", F.substring("h", 1, digits).alias("cut")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("base"))
        upto = F.col("base") + F.sum("n").over(Window.partitionBy("source").orderBy("cut"))
        sums = sums.withColumn("upto", upto).where("upto > rest and upto - n <= rest")
        bound = sums.select("source", "rest", "cut", (F.col("upto") - F.col("n")).alias("before"), "upto")
    edge = bound.select(F.col("source").alias("b_source"), "cut", (F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")).alias("edge"))
    return plan.join(edge, F.col("source").eqNullSafe(F.col("b_source")), "left").select("source", "source_size", "target", "whole", "cut", "edge")


def with_copies(docs: DataFrame, plan: DataFrame, source: str, h: Column) -> DataFrame:
    """docs with the plan's source_size and target and _copies, how often the mix takes a document."""
    plan = plan.select(F.col("source").alias("_plan_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "whole", "cut", "edge")
    extra = F.coalesce((h < F.col("cut")) | ((h == F.col("cut")) & F.col("edge")), F.lit(False))
    met = docs.join(plan, docs[source].eqNullSafe(F.col("_plan_source")))
    return met.withColumn("_copies", F.col("whole") + extra.cast("long")).drop("_plan_source", "whole", "cut", "edge")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size (words), source_size, target (of its source), taken (words taken, repeats counted).

    A null source is a source, last in order. Null or blank texts have size 0 and nothing is taken of them; a source without
    words has target 0. Rows with equal doc_id of one source are taken alike, rows without doc_id by their text; documents whose
    hash ties are taken together. Very long texts are counted whole. Repeated rows give repeated results, no rows none; other
    columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mix_hash(F.col(id_col), F.col(text_col)).alias("h")), "sized")
    plan = scratch.write(mix_plan(sized), "plan")
    return with_copies(sized, plan, "source", F.col("h")).select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: rows once, twice or not at all; columns as they were, whatever their names.

    Null and blank texts have size 0 and stay as often as the whole copies of their source say, 0 to 2 times; a source without
    words is left out. A null source is a source. Rows of equal doc_id in a source are taken alike, rows without doc_id by their
    text. Very long texts are only counted. Ties of the hash are taken together; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows, (i, text, source) = unnamed(docs, id_col, text_col, source_col)
    h = mix_hash(F.col(i), F.col(text))
    sized = scratch.write(rows.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h")), "sized")
    plan = scratch.write(mix_plan(sized), "plan")
    scratch.drop("sized")
    taken = with_copies(rows, plan, source, h).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("_copies", F.lit(1)))))
    return taken.where("_copies > 0").select(*rows.columns).toDF(*docs.columns)


ORACLE = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         left(md5(coalesce(cast(doc_id as varchar), 't' || text, '')), 9) as h
  from documents),
sums as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (
  select *, cast([5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as bigint) as w from sums),
ranked as (
  select *, row_number() over (order by 2 * source_size / w, source nulls last) as r,
         cast(3 * sum(source_size) over () - coalesce(sum(4 * source_size) over (order by 2 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as bigint) as have,
         cast(2 * (sum(w) over () - coalesce(sum(w) over (order by 2 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as bigint) as weights
  from weighed),
free as (select have, weights, r from ranked where 2 * source_size / w > have / weights order by r limit 1),
aims as (
  select k.source, k.source_size,
         case when f.r is not null and k.r >= f.r then k.w * f.have / f.weights else cast(2 * k.source_size as double) end as target
  from ranked k left join free f on true),
planned as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from aims),
marked as (
  select s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as rest,
         sum(s.size) over (partition by s.source order by s.h) as upto,
         sum(s.size) over (partition by s.source, s.h) as here
  from sized s join planned p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
       cast(size * (whole + case when upto <= rest or (upto - here <= rest and upto - rest < rest - (upto - here)) then 1 else 0 end) as bigint) as taken
from marked
"""
