"""Hierarchies as flat rows (id, parent): closure, depth, inherited values, subtree text, duplicates and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmere.plans.registry import Tables, query


def closure(nodes: DataFrame, max_depth: int = 16) -> DataFrame:
    """(ancestor, id, distance) of every node and its ancestors, itself included: one self join for each level.

    Stops at the first level that adds nothing; a tree deeper than max_depth, or a cycle, raises an error.
    """
    edges = nodes.where("parent is not null").select(F.col("id").alias("child"), "parent")
    level = nodes.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("distance"))
    out = level
    for d in range(1, max_depth + 2):
        level = level.join(edges, F.col("ancestor") == F.col("child")).select(F.col("parent").alias("ancestor"), "id", F.lit(d).alias("distance"))
        if level.isEmpty():
            return out
        if d > max_depth:
            break
        out = out.union(level)
    raise ValueError("the tree is deeper than expected or has a cycle")


def inherited(nodes: DataFrame, value: str, max_depth: int = 16) -> DataFrame:
    """(id, value) from the nearest of a node and its ancestors that has one."""
    up = closure(nodes, max_depth).join(nodes.where(F.col(value).isNotNull()).select(F.col("id").alias("ancestor"), value), "ancestor")
    return up.groupBy("id").agg(F.min_by(value, "distance").alias(value))


def subtree_text(nodes: DataFrame, max_depth: int = 16) -> DataFrame:
    """(id, text) of each node with those below it, in document order, a line each; empty texts are left out."""
    rows = nodes.where("text is not null and text <> ''").select("id", "place", "text")
    down = closure(nodes, max_depth).join(rows, "id")
    parts = down.groupBy("ancestor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "text"))).alias("p"))
    return parts.select(F.col("ancestor").alias("id"), F.array_join("p.text", "\n").alias("text"))


def geography(t: Tables) -> DataFrame:
    """Regions, nations and suppliers as one tree."""
    region = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("place"), F.col("r_name").alias("text"), F.lit("region").alias("kind"))
    nation = t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("long") + 100, F.col("n_name"), F.lit("nation"))
    supplier = t.supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_suppkey") + 1000, F.col("s_name"), F.lit("supplier"))
    return region.union(nation).union(supplier)


TREE = """
WITH RECURSIVE nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey::BIGINT AS place, r_name AS text FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey + 100, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey + 1000, s_name FROM supplier),
up AS (SELECT id AS ancestor, id, 0 AS distance FROM nodes
       UNION ALL SELECT n.parent, u.id, distance + 1 FROM up u JOIN nodes n ON n.id = u.ancestor WHERE n.parent IS NOT NULL)
"""


@query(TREE + "SELECT id, max(distance) AS depth FROM up GROUP BY id")
def tree_depth(t: Tables) -> DataFrame:
    return closure(geography(t)).groupBy("id").agg(F.max("distance").alias("depth"))


@query(TREE + "SELECT ancestor AS id, string_agg(text, chr(10) ORDER BY place, id) AS text FROM up JOIN nodes USING (id) GROUP BY 1")
def tree_subtree_text(t: Tables) -> DataFrame:
    return subtree_text(geography(t))


@query(TREE + "SELECT id, any_value(p.text) AS source FROM up JOIN (SELECT id AS ancestor, text FROM nodes WHERE parent IS NULL) p USING (ancestor) GROUP BY id")
def inherited_source(t: Tables) -> DataFrame:
    nodes = geography(t).withColumn("source", F.when(F.col("parent").isNull(), F.col("text")))
    return inherited(nodes, "source")


@query(TREE + "SELECT ancestor AS id, bool_or(starts_with(id, 's')) AS holds FROM up GROUP BY 1")
def holds_supplier(t: Tables) -> DataFrame:
    return closure(geography(t)).groupBy(F.col("ancestor").alias("id")).agg(F.bool_or(F.col("id").startswith("s")).alias("holds"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag <> 'A') AS operative,
       count(*) > 1 AND count(*) FILTER (l_returnflag <> 'A') <> 1 AS ambiguous FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def ambiguous_numbers(t: Tables) -> DataFrame:
    """Numbers that several sections bear: ambiguous unless exactly one is operative."""
    out = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "A").alias("operative"))
    return out.where("n > 1").withColumn("ambiguous", F.col("operative") != 1)


@query("""
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'empty' WHEN normative THEN 'active' WHEN any_r THEN 'repealed' ELSE 'merged' END AS status FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_linestatus = 'O') AS normative, bool_or(l_returnflag = 'R') AS any_r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def inferred_status(t: Tables) -> DataFrame:
    """A section whose parts are all notes is repealed or merged."""
    parts = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_linestatus") == "O").alias("normative"), F.bool_or(F.col("l_returnflag") == "R").alias("any_r"))
    status = F.when(F.col("normative").isNull(), "empty").when(F.col("normative"), "active").when(F.col("any_r"), "repealed").otherwise("merged")
    return t.orders.join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", status.alias("status"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus = 'O' AND NOT coalesce(dup, false) AS editable FROM lineitem
LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS n, true AS dup FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) ON k = l_orderkey AND n = l_linenumber""")
def editable_nodes(t: Tables) -> DataFrame:
    twice = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg((F.count(F.lit(1)) > 1).alias("dup"))
    out = t.lineitem.join(twice, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_linestatus") == "O") & ~F.col("dup")).alias("editable"))


def ancestor_of_kind(nodes: DataFrame, kind: str, max_depth: int = 16) -> DataFrame:
    """(id, ancestor): the nearest node of that kind at or above each node; nodes without one are left out."""
    wanted = nodes.where(F.col("kind") == kind).select(F.col("id").alias("ancestor"))
    return closure(nodes, max_depth).join(wanted, "ancestor").groupBy("id").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("ancestor"))


def reading_list(nodes: DataFrame, max_depth: int = 16) -> DataFrame:
    """(root, reading, id, depth): the nodes of each tree in the order in which one reads them, siblings by place and id."""
    up = closure(nodes, max_depth).join(nodes.select(F.col("id").alias("ancestor"), F.col("place").alias("at")), "ancestor")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "at", "ancestor")))
    paths = up.groupBy("id").agg(steps.alias("p")).select("id", F.get("p", F.lit(0))["ancestor"].alias("root"), F.transform("p", lambda x: F.struct(x["at"], x["ancestor"])).alias("path"))
    return paths.select("root", F.row_number().over(Window.partitionBy("root").orderBy("path")).alias("reading"), "id", (F.size("path") - 1).alias("depth"))


@query(TREE + """, down AS (SELECT id, id AS root, [place] AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, d.root, list_append(d.path, n.place) FROM down d JOIN nodes n ON n.parent = d.id)
SELECT root, row_number() OVER (PARTITION BY root ORDER BY path)::INT AS reading, id, (len(path) - 1)::INT AS depth FROM down""")
def tree_reading_list(t: Tables) -> DataFrame:
    return reading_list(geography(t))


@query(TREE + "SELECT id, ancestor FROM up WHERE starts_with(ancestor, 'n')")
def tree_nation_of(t: Tables) -> DataFrame:
    return ancestor_of_kind(geography(t), "nation")
