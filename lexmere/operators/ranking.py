"""Windows and sorted picks: running context, islands, ordinals, round robin, budgets, legal order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmere.functions.numbering import SUFFIXES, next_appended, next_inserted, section_key
from lexmere.functions.shared import stage
from lexmere.plans.registry import Tables, query


def islands(rows: DataFrame, key: str, order: list[str], starts: str) -> DataFrame:
    """Numbers the runs of rows within a key: a run begins where the condition starts holds."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("island", F.sum(F.when(F.expr(starts), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def round_robin(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """One row of each group in turn, groups by key, then second rows and so on, until n."""
    ranked = rows.withColumn("depth", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.orderBy("depth", group).limit(n)


@query("""
SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER w AS year_row,
       sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w AS ordinal
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def citation_ordinals(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    dated = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.last(dated, ignorenulls=True).over(w).alias("year_row"), F.sum(F.when(dated.isNotNull(), 1).otherwise(0)).over(w).alias("ordinal"))


@query("""
SELECT source, lang, doc_id, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def best_of_each_section(t: Tables) -> DataFrame:
    """The best row of each section by pre-aggregation, which a section with many rows doesn't slow."""
    best = t.documents.groupBy("source", "lang").agg(F.max_by(F.struct("doc_id", "n_chars"), F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("b"))
    return best.select("source", "lang", "b.doc_id", "b.n_chars")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey AS node FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'A', l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def first_operative(t: Tables) -> DataFrame:
    """Of the sections of one number, the first that isn't deferred, else the first."""
    first = F.min(F.struct((F.col("l_returnflag") == "A").alias("deferred"), "l_partkey", "l_suppkey")).alias("f")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", F.col("f.l_partkey").alias("node"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, depth FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS depth FROM lineitem WHERE l_quantity > 25)
ORDER BY depth, l_orderkey LIMIT 100""")
def round_robin_plan(t: Tables) -> DataFrame:
    return round_robin(t.lineitem.where("l_quantity > 25"), "l_orderkey", ["l_linenumber", "l_partkey"], 100).select("l_orderkey", "l_linenumber", "l_partkey", "depth")


@query("""
SELECT p_brand, p_partkey FROM (
  SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
WHERE r <= CASE WHEN n <= 25 THEN 12 WHEN n <= 60 THEN 6 ELSE 3 END""")
def budget_of_each_unit(t: Tables) -> DataFrame:
    """Narrow units give more rows than broad ones. The rank filter prunes each task's rows before the shuffle."""
    sizes = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    top = t.part.select("p_brand", "p_partkey", F.row_number().over(w).alias("r")).where("r <= 12")
    return top.join(sizes, "p_brand").where(F.col("r") <= F.when(F.col("n") <= 25, 12).when(F.col("n") <= 60, 6).otherwise(3)).select("p_brand", "p_partkey")


@query("""
WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR o_orderdate > before + INTERVAL 90 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT o_custkey, island, count(*) AS n, min(o_orderkey) AS first_key FROM i GROUP BY 1, 2""")
def new_runs(t: Tables) -> DataFrame:
    order = ["o_orderdate", "o_orderkey"]
    rows = t.orders.withColumn("before", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy(*order)))
    runs = islands(rows, "o_custkey", order, "before is null or o_orderdate > before + interval 90 days")
    return runs.groupBy("o_custkey", "island").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""
SELECT l_orderkey, avg(CASE WHEN step = 1 THEN 1.0 ELSE 0.0 END) >= 0.6 AS readable, count(*) AS steps FROM (
  SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS step FROM lineitem)
WHERE step IS NOT NULL GROUP BY 1""")
def numbering_readable(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - F.lag("l_linenumber").over(w)).alias("step")).where("step is not null")
    return steps.groupBy("l_orderkey").agg((F.avg(F.when(F.col("step") == 1, 1.0).otherwise(0.0)) >= 0.6).alias("readable"), F.count(F.lit(1)).alias("steps"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, lag(l_partkey) OVER w AS before, lead(l_partkey) OVER w AS after
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""")
def sibling_neighbours(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.lag("l_partkey").over(w).alias("before"), F.lead("l_partkey").over(w).alias("after"))


@query("""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS in_10_minutes,
       count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_a_day FROM events""")
def trailing_counts(t: Tables) -> DataFrame:
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")  # the nearest, of two the even one
    w = Window.partitionBy("user_id").orderBy(second)
    return t.events.select("event_id", "user_id", F.count(F.lit(1)).over(w.rangeBetween(-599, 0)).alias("in_10_minutes"), F.count(F.lit(1)).over(w.rangeBetween(-86399, 0)).alias("in_a_day"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """All rows with their place from 1 in the order, which must tell rows apart: places within ranges of the sorted
    rows, and for each range the rows before it, so that no task takes all rows."""
    at = stage(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")  # ranges are drawn once
    counts = at.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("range", F.coalesce(before, F.lit(0)).alias("start"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return at.withColumn("within", within).join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.col("within")).drop("range", "start", "within")


@query("""
SELECT p_partkey, label, row_number() OVER (ORDER BY base, letter, last NULLS FIRST, p_partkey) AS place FROM (
  SELECT p_partkey, p_size AS base, p_partkey % 31 AS letter, CASE WHEN p_partkey % 31 > 0 AND p_partkey % 4 = 0 THEN p_partkey % 5 + 1 END AS last,
         p_size::VARCHAR || CASE WHEN p_partkey % 31 = 0 THEN '' ELSE list_extract(%s, (p_partkey %% 31)::INT) END
           || CASE WHEN p_partkey %% 31 > 0 AND p_partkey %% 4 = 0 THEN (p_partkey %% 5 + 1)::VARCHAR ELSE '' END AS label FROM part)""".replace("p_partkey % ", "p_partkey %% ") % str(SUFFIXES))
def legal_order(t: Tables) -> DataFrame:
    """The place of every label in legal order."""
    letter = F.when(F.col("p_partkey") % 31 == 0, "").otherwise(F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("p_partkey") % 31).cast("int") - 1))
    last = F.when((F.col("p_partkey") % 31 > 0) & (F.col("p_partkey") % 4 == 0), (F.col("p_partkey") % 5 + 1).cast("string")).otherwise("")
    labels = t.part.select("p_partkey", F.concat(F.col("p_size").cast("string"), letter, last).alias("label"))
    return numbered(labels.withColumn("key", section_key(F.col("label"))), ["key", "p_partkey"]).select("p_partkey", "label", "place")


def labels_after(parts: DataFrame) -> DataFrame:
    label = F.col("p_size").cast("string")
    none = F.array().cast("array<string>")
    return parts.select("p_partkey", next_inserted(label, none).alias("inserted"), next_appended(label).alias("appended"), next_inserted(F.concat(label, F.lit("ב")), none).alias("after_letters"))


@query("""
SELECT p_partkey, p_size::VARCHAR || 'א' AS inserted, (p_size + 1)::VARCHAR AS appended,
       p_size::VARCHAR || 'ב' || '1' AS after_letters FROM part""")
def next_labels(t: Tables) -> DataFrame:
    return labels_after(t.part)
