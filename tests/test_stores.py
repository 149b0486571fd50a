"""The store of laws, batches under a budget, and the cache: restarts, odd rows, replays."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lexmere.operators.stores import Batches, Store, within_budget
from lexmere.streaming.caches import cached_reads
from lexmere.streaming.feeds import PARTS, limit_calls, run_to_end

LAWS = "law_id string, v string"


def content(df):
    return sorted((r.law_id or "", r.v) for r in df.collect())


def test_store_keeps_types_and_other_laws(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=3)
    assert store.rows(LAWS).count() == 0
    store.replace(spark.createDataFrame([("007", "x"), ("007", "x"), ("8", "z"), (None, "n")], LAWS), "first")
    assert content(store.rows(LAWS)) == [("", "n"), ("007", "x"), ("007", "x"), ("8", "z")]
    store.replace(spark.createDataFrame([("007", "w"), (None, "m"), ("9", "stray")], LAWS), "second", spark.createDataFrame([("007",), (None,)], "law_id string"))
    assert content(store.rows(LAWS)) == [("", "m"), ("007", "w"), ("8", "z")]
    store.replace(spark.createDataFrame([], LAWS), "gone", spark.createDataFrame([("8",), ("none",)], "law_id string"))
    assert content(store.rows(LAWS)) == [("", "m"), ("007", "w")]
    got = sorted((r.step, r.law_id or "", r.reason, r.n_before, r.n_after) for r in store.log().collect())
    assert got == [(1, "", "first", 0, 1), (1, "007", "first", 0, 2), (1, "8", "first", 0, 1), (2, "", "second", 1, 1), (2, "007", "second", 2, 1), (3, "8", "gone", 1, 0), (3, "none", "gone", 0, 0)]
    store.replace(spark.createDataFrame([], LAWS), "nothing")
    assert content(store.rows(LAWS)) == [("", "m"), ("007", "w")]
    store.replace(spark.createDataFrame([], LAWS), "all gone", store.rows(LAWS).select("law_id"))
    assert content(store.rows(LAWS)) == []
    store.replace(spark.createDataFrame([("1", "back")], LAWS), "back")
    assert content(store.rows(LAWS)) == [("1", "back")]


def test_a_killed_step_counts_for_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), buckets=2)
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], LAWS)
    store.replace(rows, "first")
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.replace(rows.where("law_id = 'a'").withColumn("v", F.lit("2")), "second")
    assert content(store.rows(LAWS)) == [("a", "1"), ("b", "1")] and {r.reason for r in store.log().collect()} == {"first"}
    store.replace(rows.where("law_id = 'b'").withColumn("v", F.lit("3")), "third")
    assert content(store.rows(LAWS)) == [("a", "1"), ("b", "3")]
    assert sorted((r.step, r.law_id) for r in store.log().collect()) == [(1, "a"), (1, "b"), (2, "b")]


def test_budget_against_a_loop(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([0, 1, 5, 9, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, cost long")
    for budget in (0, 7, 400, 10_000):
        want, total = [], 0
        for i, cost in rows:
            total += cost or 0
            if total <= budget or i == 0:
                want.append(i)
        assert sorted(r.id for r in within_budget(df, ["id"], "cost", budget).collect()) == want, budget
    assert within_budget(df.limit(0), ["id"], "cost", 5).count() == 0
    assert [r.id for r in within_budget(df.where("id = 3").withColumn("cost", F.lit(50)), ["id"], "cost", 5).collect()] == [3]


def test_batches_go_on_after_a_kill(spark, tmp_path):
    queue = spark.createDataFrame([(i, 10) for i in range(10)], "id long, cost long")
    batches = Batches(spark, str(tmp_path), 30, calls=3, window=100)
    seen = []

    def work(rows, path):
        seen.append(sorted(r.id for r in rows.collect()))
        if len(seen) == 2:
            raise RuntimeError("killed")

    assert batches.run(queue, 0, work, ["id"]) == "done"
    with pytest.raises(RuntimeError):
        batches.run(queue, 1, work, ["id"])
    assert [batches.run(queue, at, work, ["id"]) for at in (2, 3, 4, 103, 104)] == ["done", "done", "limited", "done", "empty"]
    assert seen == [[0, 1, 2], [3, 4, 5], [3, 4, 5], [6, 7, 8], [9]]
    assert sorted((r.call, r.id) for r in batches.report().collect()) == [(1, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 6), (3, 7), (3, 8), (4, 9)]


def test_cache_over_several_batches_equals_a_replay(spark, tmp_path):
    draw = random.Random(9)
    reads = [(i, draw.choice([1, 2, 3, 3, 3]), 1_700_000_000 + i * draw.choice([1, 40]), draw.choice([60, 900, None])) for i in range(400)]
    reads = sorted(reads, key=lambda r: r[2])
    schema = "read_id long, entry long, second long, life long"
    for k in range(4):
        spark.createDataFrame(reads[k * 100 : k * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("second"))
        got = run_to_end(cached_reads(source.drop("second"), "10 days"), f"{tmp_path}/run")  # each round starts again
    stored, want = {}, {}
    for read_id, entry, second, life in sorted(reads, key=lambda r: (r[2], r[0])):
        hit = entry in stored and second - stored[entry] <= (life or 0)
        if not hit:
            stored[entry] = second
        want[read_id] = (entry, hit, second - stored[entry])
    assert {r.read_id: (r.entry, r.hit, r.age) for r in got.collect()} == want


def test_cache_keeps_what_a_longer_life_can_find(spark, tmp_path):
    """The first time is out of reach of its own life, and of the watermark, when a read with a week to live comes."""
    for k, read in enumerate([(1, 1, 0, 60), (2, 2, 10_000, 60), (3, 3, 15_000, 60), (4, 1, 20_000, 604_800)]):
        spark.createDataFrame([read], "read_id long, entry long, second long, life long").write.parquet(f"{tmp_path}/in/k={k}")
    source = spark.readStream.schema("read_id long, entry long, second long, life long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    source = source.withColumn("at", F.timestamp_seconds(F.col("second") + 1_700_000_000))
    got = run_to_end(cached_reads(source, "1 second"), f"{tmp_path}/run")
    assert {tuple(r) for r in got.collect()} == {(1, 1, False, 0), (2, 2, False, 0), (3, 3, False, 0), (4, 1, True, 20_000)}


def test_state_goes_by_parts_and_null_names_change_no_number(spark, tmp_path):
    big = 2**60
    rows = [(None if k % 7 == 0 else big + k, None if k % 11 == 0 else big + k % 3000, None if k % 13 == 0 else 1_700_000_000 + k // 5) for k in range(9000)]
    for k in range(3):
        spark.createDataFrame(rows[k * 3000 : k * 3000 + 3000], "event_id long, user_id long, at long").coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
    source = spark.readStream.schema("event_id long, user_id long, at long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    reads = source.select(F.col("event_id").alias("read_id"), F.col("user_id").alias("entry"), F.timestamp_seconds("at").alias("at"), F.lit(500).alias("life"))
    order = lambda r: (r[2] is None, r[2] or 0, r[0] is None, r[0] or 0)
    hits, accepted, stored, taken = [], [], {}, {}
    for event_id, user, at in sorted(rows, key=order):
        if user is not None and at is not None:
            hit = user in stored and at - stored[user] <= 500
            stored[user] = stored[user] if hit else at
            hits.append((event_id, user, hit, at - stored[user]))
        mine = taken.setdefault(user, [])
        ok = at is None or sum(x > at - 86_400 for x in mine) < 10 and sum(x > at - 600 for x in mine) < 3
        if ok and at is not None:
            mine.append(at)
        accepted.append((event_id, user, ok))
    for k, (out, want) in enumerate([(cached_reads(reads), hits), (limit_calls(source), accepted)]):
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/{k}/out").option("checkpointLocation", f"{tmp_path}/{k}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{k}/out").collect()), key=repr) == sorted(want, key=repr)
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), q.recentProgress)) <= PARTS < 3000  # not a group for each of 3,000
