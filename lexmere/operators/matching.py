"""Joins: amendments to citations, versions, lookups, tiered title resolution, stale and missing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.functions.text import base_title, title_year, without_vowel_letters
from lexmere.plans.registry import Tables, query


def resolve_titles(titles: DataFrame, authority: DataFrame, valid: Column) -> DataFrame:
    """titles (id, title, full_title), authority (auth_id, name): id, status, auth_id.

    Two tiers, by base title and by base title without vowel letters. A tier with one authority row takes it; with
    several, the only valid one, else the title is ambiguous. A year on both sides that differs vetoes the tier's row
    and the next tier is tried. Nothing is guessed: what no tier decides is not_found.
    """
    keyed = authority.select("auth_id", "name", valid.alias("valid"), base_title(F.col("name")).alias("exact"))
    keyed = keyed.withColumn("normalized", without_vowel_letters(F.col("exact"))).withColumn("year", title_year(F.col("name")))
    out = titles.select("id", base_title(F.col("title")).alias("k"), title_year(F.col("full_title")).alias("year"))
    for tier in ("exact", "normalized"):
        row = F.struct("auth_id", "year")
        group = keyed.groupBy(F.col(tier).alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.min(row).alias("one"), F.min(F.when(F.col("valid"), row)).alias("only")
        )
        group = group.select("key", F.when(F.col("n") == 1, F.col("one")).when(F.col("n_valid") == 1, F.col("only")).alias(f"{tier}_row"), F.lit(True).alias(f"{tier}_met"))
        key = F.col("k") if tier == "exact" else without_vowel_letters(F.col("k"))
        out = out.join(group, key == F.col("key"), "left").drop("key")

    def verdict(tier: str) -> Column:
        row, met = F.col(f"{tier}_row"), F.col(f"{tier}_met")
        veto = row["year"].isNotNull() & F.col("year").isNotNull() & (row["year"] != F.col("year"))
        return F.when(met & row.isNull(), F.struct(F.lit("ambiguous").alias("status"), F.lit(None).cast("long").alias("auth_id"))).when(
            met & ~veto, F.struct(F.lit(tier).alias("status"), row["auth_id"].cast("long").alias("auth_id"))
        )

    none = F.struct(F.lit("not_found").alias("status"), F.lit(None).cast("long").alias("auth_id"))
    return out.select("id", F.coalesce(verdict("exact"), verdict("normalized"), none).alias("v")).select("id", "v.status", "v.auth_id")


@query("""
SELECT l_orderkey, l_linenumber, o_orderkey, o_custkey FROM lineitem
JOIN orders ON l_orderkey = o_orderkey AND (nullif(l_linenumber, 1) IS NULL OR o_orderstatus = 'F')""")
def resolved_amendments(t: Tables) -> DataFrame:
    """A null second key stands for any."""
    tokens = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(1)).alias("ordinal"))
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("ordinal").isNull() | (F.col("o_orderstatus") == "F"))
    return tokens.join(t.orders, on).select("l_orderkey", "l_linenumber", "o_orderkey", "o_custkey")


@query("""
SELECT c_custkey, count(o_orderkey) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS candidates
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def resolved_candidates(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    out = t.customer.select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.greatest(F.coalesce(F.size("k"), F.lit(0)), F.lit(0)).cast("long").alias("n"), F.array_join("k", ",").alias("candidates"))


@query("""
SELECT c_custkey, c_name, v.o_orderkey AS version, v.o_orderdate AS as_of FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) v ON v.o_custkey = c_custkey AND r = 1""")
def current_versions(t: Tables) -> DataFrame:
    latest = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), "o_orderkey").alias("v"))
    out = t.customer.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "c_name", F.col("v.o_orderkey").alias("version"), F.col("v.o_orderdate").alias("as_of"))


@query("""
SELECT o_orderkey, d.l_partkey AS document FROM orders LEFT JOIN (
  SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) d
ON l_orderkey = o_orderkey AND r = 1""")
def first_documents(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).getField("l_partkey").alias("document"))
    return t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "document")


@query("""
SELECT s_suppkey, count(p_partkey) AS resolved, count(*) - count(p_partkey) AS unresolved
FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 25 GROUP BY 1""")
def bindings_of_laws(t: Tables) -> DataFrame:
    bindings = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct()
    out = bindings.join(t.part.where("p_size <= 25").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.groupBy("s_suppkey").agg(F.count("p_partkey").alias("resolved"), F.count_if(F.col("p_partkey").isNull()).alias("unresolved"))


@query("""
SELECT l_orderkey, string_agg(s_name, '; ' ORDER BY l_linenumber, s_name) AS initiators
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def initiators_in_order(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "s_name"))).alias("x"))
    return listed.select("l_orderkey", F.array_join(F.col("x.s_name"), "; ").alias("initiators"))


@query("""
SELECT DISTINCT c_custkey FROM customer WHERE EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '2-HIGH')""")
def amendable_laws(t: Tables) -> DataFrame:
    sections = t.orders.where("o_orderstatus = 'O' and o_orderpriority = '2-HIGH'")
    return t.customer.join(sections, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""
SELECT c_custkey, live, ours FROM (
  SELECT user_id, max(event_id) AS live FROM events GROUP BY 1) f
JOIN (SELECT c_custkey, max(o_orderkey) AS ours FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) v ON user_id = c_custkey
WHERE live <> ours AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90 AND user_id IS NOT NULL)""")
def stale_without_drafts(t: Tables) -> DataFrame:
    feed = t.events.groupBy("user_id").agg(F.max("event_id").alias("live"))
    loaded = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("ours")).join(t.customer.select("c_custkey"), "c_custkey", "left_semi")
    stale = loaded.join(feed, F.col("c_custkey") == F.col("user_id")).where("live <> ours").select("c_custkey", "live", "ours")
    drafts = t.events.where("event_type = 'error' and value > 90").select(F.col("user_id").alias("c_custkey"))
    return stale.join(drafts, "c_custkey", "left_anti")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("""
SELECT n_nationkey, min(c_custkey) AS c_custkey, count(*) AS matches FROM nation
JOIN customer ON starts_with(c_name, 'Customer#0000000' || n_nationkey::VARCHAR) GROUP BY 1 HAVING count(*) = 1""")
def unique_prefix_matches(t: Tables) -> DataFrame:
    """A prefix join by equality: each name offers its prefixes of the lengths that keys have."""
    keys = t.nation.select("n_nationkey", F.concat(F.lit("Customer#0000000"), F.col("n_nationkey").cast("string")).alias("prefix"))
    names = t.customer.select("c_custkey", F.explode(F.array(F.substring("c_name", 1, 17), F.substring("c_name", 1, 18))).alias("prefix")).distinct()
    out = keys.join(names, "prefix").groupBy("n_nationkey").agg(F.min("c_custkey").alias("c_custkey"), F.count(F.lit(1)).alias("matches"))
    return out.where("matches = 1")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_sections(t: Tables) -> DataFrame:
    known = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_partkey").distinct().join(known, "l_partkey", "left_anti")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS laws FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def reused_ids(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("laws")).where("laws > 1")


@query("""
SELECT c_mktsegment, count(*) AS total, count(o.k) AS indexed, count(*) - count(o.k) AS not_indexed
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o ON k = c_custkey GROUP BY 1""")
def coverage(t: Tables) -> DataFrame:
    indexed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    out = t.customer.join(indexed, F.col("c_custkey") == F.col("k"), "left").groupBy("c_mktsegment")
    return out.agg(F.count(F.lit(1)).alias("total"), F.count("k").alias("indexed"), F.count_if(F.col("k").isNull()).alias("not_indexed"))


@query("""
WITH a AS (SELECT n_nationkey::BIGINT AS auth_id, n_name AS name, n_regionkey < 3 AS valid, n_name AS k FROM nation
           UNION ALL SELECT 100 + n_nationkey, n_name || ', תש"ך-1960 [נוסח]', n_regionkey = 1, n_name FROM nation WHERE n_nationkey % 3 = 0),
g AS (SELECT k, count(*) AS n, count(*) FILTER (valid) AS nv, min(auth_id) AS one, min(auth_id) FILTER (valid) AS sole FROM a GROUP BY k)
SELECT s_suppkey AS id,
       CASE WHEN k IS NULL THEN 'not_found' WHEN n > 1 AND nv <> 1 THEN 'ambiguous'
            WHEN chosen >= 100 AND s_suppkey % 2 = 0 THEN 'not_found' ELSE 'exact' END AS status,
       CASE WHEN k IS NULL OR (n > 1 AND nv <> 1) OR (chosen >= 100 AND s_suppkey % 2 = 0) THEN NULL ELSE chosen END AS auth_id
FROM (SELECT s.*, g.*, CASE WHEN n = 1 THEN one ELSE sole END AS chosen FROM (
        SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE n_name END AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey) s
      LEFT JOIN g ON g.k = s.title)""")
def tiered_resolution(t: Tables) -> DataFrame:
    """Suppliers' nations stand for titles: typed with other quotes, and every other one of the year 1961."""
    nation = t.nation.select(F.col("n_nationkey").cast("long").alias("auth_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") < 3).alias("valid"))
    more = t.nation.where("n_nationkey % 3 = 0").select(
        (F.col("n_nationkey") + 100).cast("long").alias("auth_id"), F.concat("n_name", F.lit(', תש"ך-1960 [נוסח]')).alias("name"), (F.col("n_regionkey") == 1).alias("valid")
    )
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    title = F.when(F.col("s_suppkey") % 7 == 0, "unknown").otherwise(F.col("n_name"))
    full = F.concat(title, F.when(F.col("s_suppkey") % 2 == 0, ", תשכ״א–1961").otherwise(""))
    titles = rows.select(F.col("s_suppkey").alias("id"), title.alias("title"), full.alias("full_title"))
    return resolve_titles(titles, nation.unionByName(more), F.col("valid"))
