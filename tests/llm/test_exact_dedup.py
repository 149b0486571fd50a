from __future__ import annotations

import hashlib

import pytest

from lexmere.llm import exact_dedup

from .conftest import ROWS


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize(("keep", "pick"), [("max", max), ("min", min)])
def test_against_brute_force(odd, keep, pick):
    groups = {}
    for r in ROWS:
        groups.setdefault(lower(r[1]), []).append(r[0])
    want = []
    for text, ids in groups.items():
        best = pick([i for i in ids if i is not None], default=None)
        seen = False
        for i in ids:
            want.append((i, best, len(ids), i == best and not seen, hashlib.sha256(text.encode()).hexdigest()))
            seen |= i == best
    got = [tuple(r)[:5] for r in exact_dedup.exact_groups(odd, keep=keep, bits=1, rounds=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_that_stay(odd, no_rows):
    got = exact_dedup.drop_copies(odd)
    assert got.columns == odd.columns
    kept = sorted((r.doc_id, lower(r.text)) for r in got.collect() if r.doc_id is not None)
    assert len({t for _, t in kept}) == len(kept)
    assert got.count() == len({lower(r[1]) for r in ROWS}) and got.where("doc_id = 6").count() == 1
    assert exact_dedup.drop_copies(no_rows).count() == 0 and exact_dedup.exact_groups(no_rows).count() == 0


def test_clash_is_found(spark):
    leaves = spark.createDataFrame([(0, b"d", 1, 1, 5, 5), (1, b"d", 2, 1, 6, 6)], "run int, digest binary, best long, n long, lo long, hi long")
    with pytest.raises(Exception, match="equal digests"):
        exact_dedup.tree_merge(leaves, 1, 1).collect()


def test_leaf_runs_are_sorted_and_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(5_000).select((F.col("id") % 7).cast("int").alias("run"), F.unhex(F.sha2((F.col("id") % 900).cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id"), F.lit(1).alias("copies"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    exact_dedup.leaf_runs(rows.repartition(5)).write.parquet(f"{tmp_path}/runs")
    files = {}
    for r in spark.read.parquet(f"{tmp_path}/runs").select(F.input_file_name().alias("f"), F.col("_metadata.row_index").alias("i"), "run", F.hex("digest").alias("d"), "n").collect():
        files.setdefault(r.f, []).append((r.i, r.run, r.d, r.n))
    entries = [[x[1:3] for x in sorted(f)] for f in files.values()]
    assert all(f == sorted(f) and len(f) == len(set(f)) for f in entries)
    assert sorted(run for f in entries for run in {r for r, _ in f}) == list(range(7))
    assert sum(x[3] for f in files.values() for x in f) == 5_000
