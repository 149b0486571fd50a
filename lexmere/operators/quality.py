"""Data-quality checks: each gives findings, and every check reports a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.plans.registry import Tables, query

STATUSES = ("passed", "failed", "warning", "not checked")


def findings(counts: list[tuple[str, str, DataFrame | None]]) -> DataFrame:
    """(check, severity, bad rows or None): one row for each check: check, severity, n_bad, status.

    A check without rows to look at reports "not checked"; bad rows fail an error and only warn for a warning.
    """
    spark = next(rows for _, _, rows in counts if rows is not None).sparkSession
    parts = []
    for name, severity, rows in counts:
        n = spark.range(1).select(F.lit(None).cast("long").alias("n_bad")) if rows is None else rows.agg(F.count(F.lit(1)).alias("n_bad"))
        parts.append(n.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n_bad"))
    status = F.when(F.col("n_bad").isNull(), "not checked").when(F.col("n_bad") == 0, "passed").when(F.col("severity") == "warning", "warning").otherwise("failed")
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)


@query("""
WITH c AS (
  SELECT 'unique ids' AS "check", 'error' AS severity, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_bad
  UNION ALL SELECT 'parents exist', 'error', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'numbers in order', 'warning', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) <> count(*)))
  UNION ALL SELECT 'normative content', 'error', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_linestatus = 'O')))
  UNION ALL SELECT 'known status', 'error', (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P'))
  UNION ALL SELECT 'no odd quotes', 'warning', (SELECT count(*) FROM documents WHERE contains(text, '“') OR contains(text, '”'))
  UNION ALL SELECT 'length matches', 'error', (SELECT count(*) FROM documents WHERE n_chars <> length(text))
  UNION ALL SELECT 'dates not in the future', 'error', (SELECT count(*) FROM orders WHERE o_orderdate > TIMESTAMP '2030-01-01')
  UNION ALL SELECT 'provenance', 'warning', (SELECT count(*) FROM documents WHERE source IS NULL OR lang IS NULL)
  UNION ALL SELECT 'id of one law', 'warning', (SELECT count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1))
  UNION ALL SELECT 'cited sections exist', 'error', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
  UNION ALL SELECT 'style whitelist', 'warning', NULL)
SELECT *, CASE WHEN n_bad IS NULL THEN 'not checked' WHEN n_bad = 0 THEN 'passed' WHEN severity = 'warning' THEN 'warning' ELSE 'failed' END AS status FROM c""")
def dq_findings(t: Tables) -> DataFrame:
    lines = t.lineitem
    per = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_linestatus") == "O").alias("normative"))
    return findings(
        [
            ("unique ids", "error", t.orders.groupBy("o_orderkey").count().where("count > 1")),
            ("parents exist", "error", lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
            ("numbers in order", "warning", per.where("last <> n")),
            ("normative content", "error", per.where("not normative")),
            ("known status", "error", t.orders.where("o_orderstatus is null or o_orderstatus not in ('F', 'O', 'P')")),
            ("no odd quotes", "warning", t.documents.where(F.col("text").rlike("[“”]"))),
            ("length matches", "error", t.documents.where("n_chars <> length(text)")),
            ("dates not in the future", "error", t.orders.where("o_orderdate > timestamp_ntz'2030-01-01'")),
            ("provenance", "warning", t.documents.where("source is null or lang is null")),
            ("id of one law", "warning", lines.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n > 1")),
            ("cited sections exist", "error", t.labels.join(t.documents, "doc_id", "left_anti")),
            ("style whitelist", "warning", None),
        ]
    )
