from __future__ import annotations

import glob
import os
import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmere.llm import filter_audit

from .conftest import DOCS, ROWS

LABELS = "doc_id long, quality int, toxic int, part string, step int"
MARKED = [(1, 1, 0, "x", 1), (2, 0, 1, "x", 1), (2, 1, 0, "x", 2), (5, 1, 1, None, None), (None, 1, 1, "x", 1), (20, None, 1, "x", 1), (99, 1, 1, "x", 1)]
TEXT = " ".join(f"word{k}" for k in range(60))
MORE = [
    (20, TEXT, "en", "a", 1),
    (21, TEXT, "en", "b", 1),
    (22, TEXT, "en", "a", 1),
    (22, TEXT, "en", "a", 1),
    (19, TEXT.upper(), "en", "a", 1),
    (18, TEXT + " 50%", "en", "", 1),
    (None, TEXT, "en", "a", 1),
    (23, TEXT + " Ünd \x1f  ", "de", None, 1),
]


def fails(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        yield doc_id, source or "", out + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (doc_id is not None and doc_id > first[text])


def brute(rows, labels):
    found = list(fails(rows))
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    out = {}
    for part in {p for _, p, _ in found}:
        mine = [(i, f) for i, p, f in found if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                total[x] += len(gone)
                n = sum(x in f for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), n - len(gone), sum(f == x for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("parts_each", [filter_audit.PARTS, 1])
def test_against_brute_force(spark, monkeypatch, parts_each):
    monkeypatch.setattr(filter_audit.removals, "__defaults__", (parts_each,))
    docs = spark.createDataFrame(ROWS + MORE, DOCS).withColumn("part", F.lit("clash")).withColumn("pattern", F.lit(1)).withColumn("label", F.lit(7)).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(MARKED, LABELS))
    rows = {tuple(r[:3]): list(r[3:]) for r in got.collect()}
    assert rows == brute(ROWS + MORE, MARKED)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]


def test_empty_tables(spark, no_rows):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(no_rows, labels).count() == 0
    got = filter_audit.audit(spark.createDataFrame(ROWS, DOCS), labels).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count(F.lit(1))).first()
    assert got[:2] == (0, 0) and got[2] == 600 * len({r[3] or "" for r in ROWS})


def test_table_of_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b00101, filter_audit.ORDERS.index("EDCBA")] == 2


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = db.sql(filter_audit.OP11_SQL)
    got = filter_audit.op11_filter_audit(spark, sf_dir)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
