"""Legislative statistics: grouped distinct counts, rates, top lists, priorities and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.plans.registry import Tables, query


def rate(part: Column, whole: Column) -> Column:
    """A percentage with one decimal; 0 where there is nothing to count."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))


def pass_rates(bills: DataFrame, term: Column, passed: Column, key: Column) -> DataFrame:
    """Bills, bills passed and the rate of each legislative term, latest first; rows without a term don't count."""
    return (
        bills.where(term.isNotNull())
        .groupBy(term.alias("term"))
        .agg(F.countDistinct(key).alias("total"), F.countDistinct(F.when(passed, key)).alias("passed"))
        .withColumn("rate", rate(F.col("passed"), F.col("total")))
        .orderBy(F.desc("term"))
    )


def top_counted(rows: DataFrame, who: str, what: str, limit: int = 50) -> DataFrame:
    """The limit (1 to 50) identifiers with most distinct objects, ties to the smaller identifier."""
    return rows.groupBy(who).agg(F.countDistinct(what).alias("n")).orderBy(F.desc("n"), F.asc(who)).limit(max(1, min(50, limit)))


@query("""
SELECT year(o_orderdate) AS term, count(DISTINCT o_orderkey) AS total,
       count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS passed,
       round(100.0 * count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) / count(DISTINCT o_orderkey), 1) AS rate
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def pass_rates_by_term(t: Tables) -> DataFrame:
    return pass_rates(t.orders, F.year("o_orderdate"), F.col("o_orderstatus") == "F", F.col("o_orderkey"))


@query("""
SELECT year(o_orderdate) AS term, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed,
       round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS rate
FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1""")
def pass_rate_of_one_term(t: Tables) -> DataFrame:
    return pass_rates(t.orders.where(F.year("o_orderdate") == 1995), F.year("o_orderdate"), F.col("o_orderstatus") == "F", F.col("o_orderkey"))


@query("""
SELECT o_custkey, n, c_name FROM (
  SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 50) t
LEFT JOIN customer ON c_custkey = o_custkey""")
def top_initiators(t: Tables) -> DataFrame:
    top = top_counted(t.orders, "o_custkey", "o_orderkey")
    return top.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_custkey", "n", "c_name")


@query("""
SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE contains(p_name, 'red')) AS matches
FROM part WHERE contains(p_name, 'red') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20""")
def topic_titles(t: Tables) -> DataFrame:
    found = t.part.where(F.col("p_name").contains("red"))
    total = found.agg(F.count(F.lit(1)).alias("matches"))
    top = found.orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name")
    return top.join(F.broadcast(total))  # the total is one row


@query("""
SELECT c_custkey, size, amendments, round((percent_rank() OVER (ORDER BY size) + percent_rank() OVER (ORDER BY amendments)) / 2, 6) AS priority
FROM (SELECT c_custkey, coalesce(sum(length(o_orderpriority)), 0)::BIGINT AS size, count(o_orderkey) AS amendments
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def index_priority(t: Tables) -> DataFrame:
    """Half the percent rank of a law's size, half that of its amendments.

    Percent ranks come from the counts of rows below each value: distinct values are few and ranked on their own, so
    that no window takes all rows into one task.
    """
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.length("o_orderpriority")).alias("size"), F.count("o_orderkey").alias("amendments"))
    laws = t.customer.select("c_custkey").join(orders, "c_custkey", "left").na.fill(0, ["size", "amendments"])
    total = laws.agg(F.count(F.lit(1)).alias("total"))
    for name in ("size", "amendments"):
        values = laws.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        below = values.select(name, (F.sum("n").over(Window.orderBy(name)) - F.col("n")).alias(f"below_{name}"))
        laws = laws.join(below, name)
    ranked = laws.join(F.broadcast(total))
    part = lambda n: F.when(F.col("total") > 1, F.col(f"below_{n}") / (F.col("total") - 1)).otherwise(0.0)
    return ranked.select("c_custkey", "size", "amendments", F.round((part("size") + part("amendments")) / 2, 6).alias("priority"))


@query("""
SELECT lang, count(*) AS n, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90,
       round(quantile_cont(n_chars, 0.95), 4) AS p95, round(quantile_cont(n_chars, 0.99), 4) AS p99, max(n_chars) AS longest
FROM documents GROUP BY lang""")
def length_percentiles(t: Tables) -> DataFrame:
    p = F.percentile("n_chars", [0.5, 0.9, 0.95, 0.99])
    names = ["p50", "p90", "p95", "p99"]
    out = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), p.alias("p"), F.max("n_chars").alias("longest"))
    return out.select("lang", "n", *[F.round(F.col("p")[i], 4).alias(c) for i, c in enumerate(names)], "longest")


@query("SELECT source, count(*) AS chunks FROM documents WHERE text IS NOT NULL GROUP BY source")
def chunks_of_laws(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


@query("""
SELECT l_orderkey, count(*) AS nodes, count(*) FILTER (l_returnflag = 'N') AS sections, sum(l_quantity) AS chars,
       bool_or(l_linestatus = 'F') AS any_normative FROM lineitem GROUP BY 1""")
def ingest_totals(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("l_returnflag") == "N").alias("sections"),
        F.sum("l_quantity").alias("chars"),
        F.bool_or(F.col("l_linestatus") == "F").alias("any_normative"),
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
SELECT o_orderpriority AS level, o_orderstatus AS family, count(*) AS variants, count(DISTINCT o_custkey) AS groups
FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def availability(t: Tables) -> DataFrame:
    out = t.orders.rollup(F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("family"))
    return out.agg(F.count(F.lit(1)).alias("variants"), F.countDistinct("o_custkey").alias("groups"))


@query("""
SELECT count(*) AS calls FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def calls_in_last_hour(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(now)).where("ts >= now - INTERVAL 1 HOUR").agg(F.count(F.lit(1)).alias("calls"))


@query("""
SELECT o_custkey, count(*) AS n, CAST(ceil(greatest(0, count(*) - 10) / 5.0) * 3 AS BIGINT) AS price
FROM orders GROUP BY 1""")
def block_prices(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("price", (F.ceil(F.greatest(F.lit(0), F.col("n") - 10) / 5.0) * 3).cast("long"))


@query("""
SELECT p_brand, p_size AS size, n FROM (
  SELECT p_brand, p_size, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY 1, 2)
WHERE r = 1""")
def most_common_size(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_brand", F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("size", "n"), F.struct(F.col("n"), -F.col("size"))).alias("b")
    return n.groupBy("p_brand").agg(best).select("p_brand", "b.size", "b.n")


@query("""
SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), 'license|password|email')) AS kind FROM documents) GROUP BY 1""")
def marked_changes(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(license|password|email)"), F.lit(1))).alias("kind"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""
SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS principal, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END)::BIGINT AS other
FROM events GROUP BY 1""")
def instruction_counts(t: Tables) -> DataFrame:
    main = F.coalesce(F.col("value") > 50, F.lit(False))
    return t.events.groupBy("event_type").agg(F.count_if(main).alias("principal"), F.count_if(~main).alias("other"))
