from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexmere.operators.labels import plan_facets
from lexmere.operators.retrieval import fuse

CASES = [
    ('{"facets": [["ab", "cd"], ["ef"]]}', [["ab", "cd"], ["ef"]]),
    ('{"facets": ["ab", "cd", "x", "ab"]}', [["ab", "cd"]]),
    ('{"facets": [["ab", 7, "7", null], "cd", 5, {"a": 1}, null]}', [["ab"], ["cd"]]),
    ('{"facets": [["11", " 11 ", "q"], [], ["a"], ["bc"], ["de"], ["fg"]]}', [["11"], ["bc"], ["de"]]),
    ('```json\n{"facets": [["a, b", "[c", "\\"d\\""]]}\n```', [["a, b", "[c", '"d"']]),
    ('{"facets": []}', []),
    ('{"facets": "ab"}', []),
    ('{"units": []}', []),
    ("no plan", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(CASES)], "k int, raw string")
    return {r.k: r.f for r in rows.select("k", plan_facets(F.col("raw")).alias("f")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_facets(found, k):
    assert found[k] == CASES[k][1]


def test_units_match_as_terms_do(spark):
    """Prefix letters, hyphens and short words whole."""
    titles = ["חוק הבנקאות והרישוי", "חוק־יסוד: הבנקאות-רישוי", "דו-קיום", "חוק דומה", None, "בנק הבנקאות"]
    rows = spark.createDataFrame([(k, x, k) for k, x in enumerate(titles)], "id long, title string, newest long")
    got = lambda *units: [r.id for r in fuse(rows, list(units)).collect()]
    assert got("בנקאות רישוי") == [1, 0]
    assert got("דו קיום", "בנק הבנק") == [2, 5]
    assert fuse(rows.limit(0), ["בנקאות רישוי"]).count() == 0
