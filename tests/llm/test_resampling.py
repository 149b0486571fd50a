from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmere.llm import resampling

from .conftest import DOCS, ROWS

TARGET = "item_id long, text string, doc_id string"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, least=20, percent=5):
    found = [(i, *features(x)) for i, x in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = s.total(), t.total()
    out = []
    for i, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out]


def key(r):
    return tuple(math.inf if x is None else x for x in r)


@pytest.mark.parametrize(("least", "percent"), [(20, 5), (1, 60), (0, 100), (5, 0)])
def test_against_brute_force(spark, least, percent):
    more = [(100 + k, " ".join(f"w{(k * j) % 37} Été" for j in range(5 + k)), "fr", "a", 1) for k in range(60)]
    docs = spark.createDataFrame(ROWS + more, DOCS).withColumn("bucket", F.lit(1)).withColumn("row", F.lit(1)).withColumn("rank", F.lit("x")).repartition(5)
    texts = ["w1 été w2 brown fox", None, "", "w3 Été", "only-here"]
    target = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(texts)], TARGET)
    got = resampling.resample(docs, target, least_words=least, percent=percent)
    want = brute([(r[0], r[1]) for r in ROWS + more], texts, least, percent)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]


def test_empty_tables(spark, odd, no_rows):
    target = spark.createDataFrame([(1, "a b", "x")], TARGET)
    assert resampling.resample(no_rows, target).count() == 0
    got = resampling.resample(odd, target.limit(0)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute([(r[0], r[1]) for r in ROWS], []), key=key)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    read = lambda name, c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(c, "text").collect()]
    want = brute(read("documents", "doc_id"), [x for _, x in read("benchmark", "item_id")])
    assert sorted(map(tuple, resampling.op13_resampling(spark, sf_dir).collect()), key=key) == sorted(want, key=key)


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = db.sql(resampling.OP13_SQL)
    got = resampling.op13_resampling(spark, sf_dir)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)
