"""Queries that give every row, where an older one's SQL asks for a part."""

from __future__ import annotations

from lexmere.operators.ranking import numbered
from lexmere.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_every_label_has_a_place(spark):
    rows = QUERIES["legal_order"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/part.parquet").count() > 200
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1))
    few = spark.createDataFrame([(5, 1), (3, 2), (3, 1)], "a int, b int")
    assert sorted(map(tuple, numbered(few, ["a", "b"]).collect())) == [(3, 1, 1), (3, 2, 2), (5, 1, 3)]


def test_every_order_and_label(spark):
    count = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet").count()
    assert QUERIES["amendment_notes"](spark, SF_DIR).count() == 6 * count("orders")
    assert QUERIES["next_labels"](spark, SF_DIR).count() == count("part")
