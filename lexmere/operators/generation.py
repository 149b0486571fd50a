"""Variants of texts under guards, and round-robin plans over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmere.plans.registry import Tables, query


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, unnest([l_quantity * 0.5, l_quantity * 2, l_quantity + 10]) AS value, unnest([1, 2, 3]) AS level FROM lineitem WHERE l_quantity >= 40""")
def value_variants(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    levels = F.posexplode(F.array(q * 0.5, q * 2, q + 10)).alias("p", "value")
    return t.lineitem.where(q >= 40).select("l_orderkey", "l_linenumber", "l_partkey", levels).select("l_orderkey", "l_linenumber", "l_partkey", "value", (F.col("p") + 1).alias("level"))


@query("""
SELECT a.n_nationkey AS actor, b.n_nationkey AS other, a.n_name || ' with the approval of ' || b.n_name AS text
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def actor_approvals(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("actor"), F.col("n_name").alias("x"), "n_regionkey")
    b = t.nation.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").where("actor <> other").select("actor", "other", F.concat("x", F.lit(" with the approval of "), "y").alias("text"))


@query("""
SELECT text, min(p_partkey) AS first_key, count(*) AS n FROM (
  SELECT p_partkey, unnest([p_name || ' (large)', split_part(p_name, ' ', 1) || ' (large)']) AS text FROM part) GROUP BY 1""")
def candidate_pool(t: Tables) -> DataFrame:
    """Equal texts once, the first one's key."""
    both = F.array(F.concat("p_name", F.lit(" (large)")), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" (large)")))
    return t.part.select("p_partkey", F.explode(both).alias("text")).groupBy("text").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_brand, p_partkey, depth FROM (
  SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS depth FROM part WHERE NOT contains(p_name, 'red')) ORDER BY depth, p_brand LIMIT 60""")
def guarded_plan(t: Tables) -> DataFrame:
    rows = t.part.where(~F.col("p_name").contains("red"))
    ranked = rows.withColumn("depth", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("depth <= 60")
    return ranked.orderBy("depth", "p_brand").limit(60).select("p_brand", "p_partkey", "depth")


def plan(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows: the first row of each group, then second rows and so on, groups by their first row; the rows taken are
    placed in document order, with the number that their group has and gives. ``order`` must tell all rows apart."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("depth", F.row_number().over(w.orderBy(*order))).where(F.col("depth") <= n).withColumn("first", F.min(F.struct(*order)).over(w))
    taken = ranked.orderBy("depth", "first").limit(n).drop("first")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("available"))
    placed = taken.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows
    return placed.withColumn("chosen", F.count(F.lit(1)).over(w)).join(sizes, group)


@query("""
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS depth, p_retailprice FROM part WHERE p_size > 20),
k AS (SELECT *, first_value(p_retailprice) OVER w AS f, first_value(p_partkey) OVER w AS g FROM r WINDOW w AS (PARTITION BY p_brand ORDER BY depth)),
x AS (SELECT * FROM k ORDER BY depth, f, g LIMIT 60)
SELECT p_brand, p_partkey, depth::INT AS depth, row_number() OVER (ORDER BY p_retailprice, p_partkey)::INT AS place, count(*) OVER (PARTITION BY p_brand) AS chosen,
       (SELECT count(*) FROM r WHERE r.p_brand = x.p_brand) AS available FROM x""")
def ordered_plan(t: Tables) -> DataFrame:
    rows = t.part.where("p_size > 20").select("p_brand", "p_partkey", "p_retailprice")
    return plan(rows, "p_brand", ["p_retailprice", "p_partkey"], 60).select("p_brand", "p_partkey", "depth", "place", "chosen", "available")
