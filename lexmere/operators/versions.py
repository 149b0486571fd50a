"""Versions: differences by identifier and content hash, word edits, ordered edits applied as a whole or not at all."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmere.functions.shared import slices
from lexmere.functions.text import joined_hash
from lexmere.plans.registry import Tables, query

EDIT = (("op", pa.string()), ("old", pa.string()), ("new", pa.string()), ("at", pa.int32()))


def version_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """before and after (id, hash): id and change (added, removed, changed); equal rows are left out."""
    b, a = before.select("id", F.col("hash").alias("hash_before")), after.select("id", F.col("hash").alias("hash_after"))
    change = F.when(F.col("hash_before").isNull(), "added").when(F.col("hash_after").isNull(), "removed").when(F.col("hash_before") != F.col("hash_after"), "changed")
    return b.join(a, "id", "full").select("id", change.alias("change")).where("change is not null")


def word_edits(before: str, after: str) -> list[dict]:
    """Edits of whole words that turn before into after; at is the place among before's words."""
    x, y = before.split(), after.split()
    out = []
    for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag != "equal":
            out.append({"op": tag, "old": " ".join(x[i:j]), "new": " ".join(y[k:m]), "at": i})
    return out


def text_edits(rows: DataFrame) -> DataFrame:
    """rows (before, after, and any others): the others with a row for each edit (op, old, new, at); null is an empty text.
    Edits are told a few rows at a time."""
    kept = [c for c in rows.columns if c not in ("before", "after")]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(k, e) for k, (x, y) in enumerate(zip(part["before"].to_pylist(), part["after"].to_pylist())) for e in word_edits(x or "", y or "")]
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[part[c].take(at) for c in kept], *[pa.array([e[c] for _, e in found], kind) for c, kind in EDIT]], names=[*kept, *[c for c, _ in EDIT]])

    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.IntegerType() if c == "at" else T.StringType()) for c, _ in EDIT]])
    return rows.select(*kept, "before", "after").mapInArrow(told, schema)


def apply_edits(nodes: DataFrame, edits: DataFrame, rows_each: int = 50_000) -> DataFrame:
    """nodes (law, id, text, place), edits (law, seq, op, target, text): the nodes after their law's edits in order.

    Operations: replace, delete, insert_after. A law with an edit whose target isn't there keeps all its nodes as they
    were and names the edit in error.
    """

    def merge_one(law: int, start: list[list[str]], todo: list[tuple]) -> list[tuple]:
        now, error = [list(r) for r in start], None
        for seq, op, target, text in todo:
            at = next((k for k, r in enumerate(now) if r[0] == target), None)
            if at is None:
                now, error = start, f"edit {seq}: no {target}"
                break
            if op == "replace":
                now[at][1] = text
            elif op == "delete":
                now.pop(at)
            else:
                now.insert(at + 1, [f"{target}+{seq}", text])
        return [(law, i, text, k, error) for k, (i, text) in enumerate(now)]

    def merge(rows: pa.Table, todo: pa.Table) -> pa.Table:
        wanted: dict[int, list[tuple]] = {}
        for e in todo.sort_by("seq").to_pylist():
            wanted.setdefault(e["law"], []).append((e["seq"], e["op"], e["target"], e["text"]))
        laws: dict[int, list[list[str]]] = {}
        for r in rows.sort_by([("place", "ascending"), ("id", "ascending")]).to_pylist():
            laws.setdefault(r["law"], []).append([r["id"], r["text"]])
        out = [r for law, start in laws.items() for r in merge_one(law, start, wanted.get(law, []))]
        names, types = ("law", "id", "text", "place", "error"), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

    def dealt(df: DataFrame) -> DataFrame:
        return df.toDF(*df.columns).withColumn("bucket", F.pmod(F.xxhash64("law"), F.lit(buckets)))  # both sides may come from one table

    buckets = max(8, -(-nodes.count() // rows_each))  # many laws share a task's call; none is split
    return dealt(nodes).groupBy("bucket").cogroup(dealt(edits).groupBy("bucket")).applyInArrow(merge, "law long, id string, text string, place long, error string")


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("id"), joined_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("hash"))
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = t.orders.where("o_orderkey % 10 <> 4").select(F.col("o_orderkey").alias("id"), joined_hash(status, F.col("o_orderpriority")).alias("hash"))
    return old, new


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN 'added' WHEN o_orderkey % 10 = 4 THEN 'removed' ELSE 'changed' END AS change
FROM orders WHERE o_orderkey % 10 IN (3, 4) OR (o_orderkey % 7 = 0 AND o_orderstatus <> 'X')""")
def version_diff(t: Tables) -> DataFrame:
    return version_changes(*snapshots(t))


@query("""
SELECT change, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'added' WHEN o_orderkey % 10 = 4 THEN 'removed' ELSE 'changed' END AS change
  FROM orders WHERE o_orderkey % 10 IN (3, 4) OR o_orderkey % 7 = 0) GROUP BY 1""")
def change_counts(t: Tables) -> DataFrame:
    return version_changes(*snapshots(t)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, string_agg(kind, ';' ORDER BY l_linenumber, kind) AS lines FROM (
  SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'In line ' || l_linenumber || ', delete ' || l_partkey
    WHEN 'R' THEN 'In line ' || l_linenumber || ', replace ' || l_partkey || ' by ' || l_suppkey ELSE 'After line ' || l_linenumber || ' insert ' || l_suppkey END AS kind FROM lineitem) GROUP BY 1""")
def rendered_instructions(t: Tables) -> DataFrame:
    line, part, supp = (F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    kind = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("In line "), line, F.lit(", delete "), part))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("In line "), line, F.lit(", replace "), part, F.lit(" by "), supp))
        .otherwise(F.concat(F.lit("After line "), line, F.lit(" insert "), supp))
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", kind.alias("kind"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "kind"))).alias("x")).select("l_orderkey", F.array_join("x.kind", ";").alias("lines"))


@query()
def text_edit_operations(t: Tables) -> DataFrame:
    """Word edits between consecutive turns of a conversation."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = t.conversations.select("conv_id", "turn", F.col("text").alias("before"), after.alias("after")).where("after is not null")
    return text_edits(pairs)


@query()
def merged_versions(t: Tables) -> DataFrame:
    """Lines of an order under edits: every 5th order loses its first line, and every 50th has an edit without target."""
    nodes = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    nodes = nodes.select(F.col("l_orderkey").alias("law"), F.concat(F.lit("n"), "l_linenumber").alias("id"), F.col("p").cast("string").alias("text"), F.col("l_linenumber").cast("long").alias("place"))
    first = nodes.where("law % 5 = 0").groupBy("law").agg(F.min("id").alias("target"))
    edits = first.select("law", F.lit(1).alias("seq"), F.lit("delete").alias("op"), F.when(F.col("law") % 50 == 0, "none").otherwise(F.col("target")).alias("target"), F.lit("").alias("text"))
    return apply_edits(nodes, edits)
