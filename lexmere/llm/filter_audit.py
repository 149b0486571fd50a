"""Audit of filters that are applied one after the other: what each removes in each order, alone, or in vain.

A document's failed filters are five bits. A table with a row for each of the 32 patterns and a column for each of the 120
orders says at which step that order removes a document with that pattern, so that one look-up a document audits all
orders. Tasks count their rows by part, pattern and label, look the patterns up and count what each order removes at each
step; Spark sums these arrays. Texts stay where they are read: for copies only digests and identifiers meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.llm.common import UPPER, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The bits of the filters that only look at the text, and of the one that looks for earlier copies.
SHORT, REPEATED, SHOUTED, MARKED, COPIED = (1 << k for k in range(len(FILTERS)))
#: Parts that a task counts before it hands its arrays on and starts afresh: about 4 MB.
PARTS = 4096
#: Bits of a label: of good quality, toxic.
GOOD, TOXIC = 1, 2
MARKS, LETTERS = b"#$%&*|", UPPER.encode()
STEPS = "part string, filter_order string, step int, documents long, removed long, good_lost long, toxic_lost long, failing long, unique_fails long"


def first_failures(orders: list[str] = ORDERS, filters: str = FILTERS) -> np.ndarray:
    """Of each pattern of failed filters and each order, the step from 0 that removes it; the number of steps if none."""
    bit = np.array([[1 << filters.index(f) for f in o] for o in orders])
    fails = (np.arange(1 << len(filters))[:, None, None] & bit) > 0
    return np.where(fails.any(2), fails.argmax(2), len(filters))


def text_pattern(text: bytes, points: int) -> int:
    """The failed filters that one text in UTF-8 of so many code points tells by itself."""
    words = text.split()  # at the white space of ASCII
    out = SHORT * (len(words) < 50) | REPEATED * (100 * len(set(words)) < 65 * len(words))
    out |= SHOUTED * (100 * (len(text) - len(text.translate(None, LETTERS))) > 5 * points)
    return out | MARKED * (len(text.translate(None, MARKS)) < len(text))


def patterns(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, digest, pattern) of each row of docs; a null text counts as empty, a null part as ''."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).fill_null("")
            points = pc.utf8_length(texts).to_pylist()
            raw = [x.as_buffer().to_pybytes() for x in texts]
            digest = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
            found = pa.array([text_pattern(x, n) for x, n in zip(raw, points, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digest, found], names=["doc_id", "part", "digest", "pattern"])

    return rows.mapInArrow(look, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, digest binary, pattern int")


def label_bits(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of each labelled document: where it is labelled several times, what any of its labels says."""
    said = lambda c, bit: F.when(F.col(c) == 1, bit).otherwise(0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.bit_or(said("quality", GOOD).bitwiseOR(said("toxic", TOXIC))).alias("label"))


def weighed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, part, digest, pattern, label) as (part, pattern, label, n): how many rows have each whole pattern.

    A row is a copy if a smaller doc_id has its digest. Of each digest's rows only their number and smallest identifier
    a part and label move, so that a digest with a third of all rows is a few rows here. Rows without identifier are no
    copies, nor are repeated rows (same identifier and text) copies of each other.
    """
    own = ["digest", "part", "pattern", "label"]
    each = rows.groupBy("doc_id", *own).agg(F.count(F.lit(1)).alias("n"))  # repeated rows become one
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = each.groupBy(*own).agg(F.min(named).alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    groups = groups.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("digest")))  # a row for each part and label
    clear = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = groups.select("part", "pattern", "label", "n", clear.alias("clear"))
    split = F.array(F.struct("pattern", F.col("clear").alias("n")), F.struct(F.col("pattern").bitwiseOR(F.lit(COPIED)).alias("pattern"), (F.col("n") - F.col("clear")).alias("n")))
    return both.select("part", "label", F.explode(split).alias("x")).select("part", "x.pattern", "label", "x.n").where("n > 0")


def removals(rows: DataFrame, parts_each: int = PARTS) -> DataFrame:
    """rows (part, pattern, label, n): for each part, order and step the sums of what tasks have counted."""
    table = first_failures()
    steps = len(FILTERS)
    letter = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])  # of each order and step, its filter
    cell = np.arange(len(ORDERS)) * (steps + 1) + table  # of each pattern and order, where it counts

    def arrays(counts: np.ndarray) -> list[np.ndarray]:
        """counts [part, pattern, label] as arrays [part, order, step]."""
        n = len(counts)
        at = (np.arange(n)[:, None, None] * len(ORDERS) * (steps + 1) + cell).ravel()

        def lost(of: np.ndarray) -> np.ndarray:  # [part, pattern]
            sums = np.bincount(at, np.repeat(of.ravel(), len(ORDERS)), n * len(ORDERS) * (steps + 1))
            return sums.reshape(n, len(ORDERS), steps + 1)[:, :, :steps].astype(np.int64)

        whole = counts.sum(2)
        fails = np.stack([whole[:, (np.arange(1 << steps) >> f) & 1 == 1].sum(1) for f in range(steps)], 1)
        alone = whole[:, [1 << f for f in range(steps)]]
        by_label = [sum(counts[:, :, x] for x in range(4) if x & bit) for bit in (GOOD, TOXIC)]
        documents = np.broadcast_to(whole.sum(1)[:, None, None], (n, len(ORDERS), steps))
        return [documents, lost(whole), *map(lost, by_label), fails[:, letter], alone[:, letter]]

    def told(place: dict[str, int], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = list(place)
        for k in range(0, len(names), 64):
            some = names[k : k + 64]
            cols = arrays(counts[k : k + len(some)])
            each = len(ORDERS) * steps
            part = pa.array(some).take(pa.array(np.repeat(np.arange(len(some)), each)))
            order = pa.array(ORDERS).take(pa.array(np.tile(np.repeat(np.arange(len(ORDERS)), steps), len(some))))
            step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(some) * len(ORDERS)))
            yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(np.ascontiguousarray(c).ravel().astype(np.int64)) for c in cols)], names=[x.split()[0] for x in STEPS.split(", ")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        counts = np.zeros((0, 1 << steps, 4), np.int64)
        for b in batches:
            coded = b.column(0).dictionary_encode()
            here = np.array([place.setdefault(x, len(place)) for x in coded.dictionary.to_pylist()], np.int64)
            counts = np.concatenate((counts, np.zeros((len(place) - len(counts), *counts.shape[1:]), np.int64)))
            at = (here[coded.indices.to_numpy()] * (1 << steps) + b.column(1).to_numpy()) * 4 + b.column(2).to_numpy()
            counts += np.bincount(at, b.column(3).to_numpy(), counts.size).astype(np.int64).reshape(counts.shape)
            if len(place) >= parts_each:
                yield from told(place, counts)
                place, counts = {}, np.zeros((0, 1 << steps, 4), np.int64)
        yield from told(place, counts)

    partial = rows.select("part", F.col("pattern").cast("long"), F.col("label").cast("long"), F.col("n").cast("long")).mapInArrow(count, STEPS)
    sums = [F.sum(c).alias(c) for c in ("documents", "removed", "good_lost", "toxic_lost", "failing", "unique_fails")]
    return partial.groupBy("part", "filter_order", "step").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    docs needs id_col and text_col (and ``source``, unless part is given), labels doc_id, quality and toxic; other columns
    of either, whatever their names, are left alone. Null texts are empty: they fail A alone, or A and E. Null parts
    are ''. Rows without identifier have no label and are no copies; repeated rows count each, and are no copies of each
    other; a document that is labelled twice has what either label says. Long texts are looked at whole. An empty table
    gives an empty result, an empty table of labels zeros.
    """
    rows = patterns(docs, F.col("source") if part is None else part, id_col, text_col)
    rows = rows.join(label_bits(labels), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    out = removals(weighed(rows))
    upto = Window.partitionBy("part", "filter_order").orderBy("step")
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - F.sum("removed").over(upto)).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(same).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
           || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
os AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o),
z AS (
  SELECT part, filter_order, step, sum(n) AS documents,
         coalesce(sum(n) FILTER (contains(fails, filter_order[step])), 0) AS failing,
         coalesce(sum(n) FILTER (contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails), 0) AS removed,
         coalesce(sum(good) FILTER (contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (contains(fails, filter_order[step]) AND translate(fails, filter_order[1:step - 1], '') = fails), 0) AS toxic_lost,
         coalesce(sum(n) FILTER (fails = filter_order[step]), 0) AS unique_fails
  FROM m, os GROUP BY ALL)
SELECT part, filter_order, step,
       (documents - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept,
       removed::BIGINT AS removed, (failing - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM z
"""
