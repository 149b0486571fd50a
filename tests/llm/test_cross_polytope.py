from __future__ import annotations

import numpy as np
import pytest

from lexmere.llm import cross_polytope as cp


def brute(rows, is_query, k=20):
    out = {}
    for q, x in rows:
        if is_query(q):
            x = np.array(x)
            found = sorted((-float((x * np.array(y)).sum()), i) for i, y in rows if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_hadamard():
    x = np.eye(8)
    h = cp.hadamard(x)
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


@pytest.mark.parametrize("block", [2048, 100])
def test_recall_order_and_ties(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x[300:700] = x[300]  # a third of all rows alike: ties, and buckets of many blocks
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in cp.nearest(docs, lambda v: v % 20 == 0, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, lambda q: q % 20 == 0)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    assert [i for i, _ in got[320]] == [i for i, _ in want[320]]  # the smallest ids of 400 equal vectors


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i % 5 + 1), 1.0, -2.0 * (i % 3)]) for i in range(12)]
    bad = [(20, None), (40, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (80, [nan, 1.0, 1.0]), (100, [inf, 1.0, 1.0]), (120, []), (None, [1.0, 1.0, 1.0])]
    other = [(200, [1.0, 2.0]), (201, [2.0, 1.0])]
    docs = spark.createDataFrame(good + good[:2] + bad + other, "vec_id long, embedding array<double>")
    got = {}
    for r in cp.nearest(docs, lambda v: v % 20 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 200} and got[200] == [(201, 4.0)]
    assert got[0] == brute(good, lambda q: q == 0)[0]
    assert cp.nearest(docs.where("vec_id is null"), lambda v: v % 20 == 0).count() == 0
