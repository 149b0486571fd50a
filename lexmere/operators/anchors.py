"""Anchors: the values in texts with their places and whether they stand in a reference or a citation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmere.functions.shared import slices
from lexmere.functions.spans import anchors, citations, references
from lexmere.plans.registry import Tables, query

ANCHOR = (("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("in_reference", pa.bool_()), ("in_citation", pa.bool_()))
SPAN = "array<struct<start:int,end:int,kind:string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1000):
        at, found = [], []
        for k, text in enumerate(part["text"].to_pylist()):
            mine = anchors(text)
            at += [k] * len(mine)
            found += mine
        columns = list(zip(*found)) or [()] * len(ANCHOR)
        yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(at, pa.int64())), *[pa.array(x, kind) for x, (_, kind) in zip(columns, ANCHOR)]], names=["id", *[c for c, _ in ANCHOR]])


def _read_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    told = lambda pairs, kind: [{"start": s, "end": e, "kind": kind} for s, e in pairs]
    for texts in batches:
        yield texts.map(lambda x: told(references(x), "reference") + told(citations(x), "citation"))


def with_digits(rows: DataFrame) -> DataFrame:
    """Rows whose text has a digit: others have no anchor, no label in digits and no year, and so don't go to Python."""
    return rows.where(F.col("text").rlike("[0-9]"))


def text_anchors_of(rows: DataFrame) -> DataFrame:
    """rows (id, text, and any others, which don't count): a row for each anchor (id, start, end, text, kind,
    in_reference, in_citation). Null and empty texts have none; equal rows give equal anchors; texts are read whole, in
    time that grows with their length."""
    kinds = {pa.int32(): T.IntegerType(), pa.string(): T.StringType(), pa.bool_(): T.BooleanType()}
    schema = T.StructType([rows.schema["id"], *[T.StructField(c, kinds[kind]) for c, kind in ANCHOR]])
    return with_digits(rows).select("id", "text").mapInArrow(_read, schema)


def spans_of(rows: DataFrame) -> DataFrame:
    """rows (id, text): spans of references and of cited laws (id, start, end, kind). Null and empty texts have none."""
    cut = rows.where(F.col("text").rlike(r"[0-9(]")).select("id", F.explode(F.pandas_udf(_read_spans, SPAN)("text")).alias("s"))  # a label may be brackets alone
    return cut.select("id", "s.*")


def changeable(found: DataFrame) -> DataFrame:
    """Anchors whose value may be changed: neither in a reference nor in a citation."""
    return found.where(~F.col("in_reference") & ~F.col("in_citation"))


@query(r"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS x, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS i FROM documents),
digits AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+|[^0-9]+')) AS x, generate_subscripts(regexp_extract_all(text, '[0-9]+|[^0-9]+'), 1) AS i FROM documents),
r AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM runs),
d AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM digits),
a AS (SELECT doc_id, e, x, 'number' AS kind FROM r WHERE regexp_full_match(x, '[0-9]{1,4}') UNION ALL SELECT doc_id, e, x, 'gregorian_year' FROM d WHERE regexp_full_match(x, '(18|19|20)[0-9]{2}'))
SELECT doc_id, (e - length(x))::INT AS start, e::INT AS "end", x AS text, min(kind) AS kind, false AS in_reference, false AS in_citation FROM a GROUP BY doc_id, e, x""")
def text_anchors(t: Tables) -> DataFrame:
    """Years and numbers of every document."""
    return text_anchors_of(t.documents.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber::VARCHAR AS n, (l_partkey % 97 + 1)::VARCHAR AS m, (l_suppkey % 30 + 1)::VARCHAR AS d, (1800 + l_orderkey % 200)::VARCHAR AS w FROM lineitem),
s AS (SELECT *, 'בסעיפים ' AS p0, n AS v0, ', ' AS p1, m || 'א' AS v1, ' ו-' AS p2, n AS v2, '(ב), ' AS p3, d AS v3, ' ימים לפי חוק הבנקאות (תיקון מס'' ' AS p4, m AS v4, '), ' AS p5, 'התשע"ח' AS v5, '–' AS p6, '2018' AS v6, ' ועד ' AS p7, w AS v7 FROM b),
e AS (SELECT *, length(p0) AS s0, length(p0 || v0 || p1) AS s1, length(p0 || v0 || p1 || v1 || p2) AS s2, length(p0 || v0 || p1 || v1 || p2 || v2 || p3) AS s3,
  length(p0 || v0 || p1 || v1 || p2 || v2 || p3 || v3 || p4) AS s4, length(p0 || v0 || p1 || v1 || p2 || v2 || p3 || v3 || p4 || v4 || p5) AS s5, length(p0 || v0 || p1 || v1 || p2 || v2 || p3 || v3 || p4 || v4 || p5 || v5 || p6) AS s6,
  length(p0 || v0 || p1 || v1 || p2 || v2 || p3 || v3 || p4 || v4 || p5 || v5 || p6 || v6 || p7) AS s7 FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, start::INT AS start, text, kind, in_reference, in_citation FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, s0 AS start, v0 AS text, 'number' AS kind, true AS in_reference, false AS in_citation FROM e UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, s1, v1, 'section_ref', true, false FROM e UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, s2, v2, 'number', true, false FROM e UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, s3, v3, 'number', false, false FROM e UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, s4, v4, 'number', false, true FROM e UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, s5, v5, 'hebrew_year', false, true FROM e UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, s6, v6, 'gregorian_year', false, true FROM e UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, s7, v7, 'gregorian_year', false, false FROM e)""")
def legal_anchors(t: Tables) -> DataFrame:
    """Anchors of a sentence for each line: a list of references, a quantity, a cited law and a year of its own."""
    n, m = F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 97 + 1).cast("string")
    d, w = (F.col("l_suppkey") % 30 + 1).cast("string"), (1800 + F.col("l_orderkey") % 200).cast("string")
    text = F.concat(F.lit("בסעיפים "), n, F.lit(", "), m, F.lit("א ו-"), n, F.lit("(ב), "), d, F.lit(" ימים לפי חוק הבנקאות (תיקון מס' "), m, F.lit('), התשע"ח–2018 ועד '), w)
    rows = t.lineitem.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("id"), text.alias("text"))
    return text_anchors_of(rows).select("id.*", "start", "text", "kind", "in_reference", "in_citation")
