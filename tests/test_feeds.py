from __future__ import annotations

import datetime

import pandas as pd

from lexmere.plans.catalog import QUERIES
from lexmere.streaming import feeds


def test_refresh_goes_on_after_a_restart(spark, tmp_path):
    source, path = f"{tmp_path}/feed", f"file://{tmp_path}/table"
    schema = "title long, revision long"
    run = lambda: {tuple(r) for r in feeds.refresh(spark.readStream.schema(schema).parquet(source), path).collect()}
    spark.createDataFrame([], schema).write.parquet(source)
    assert run() == set()
    spark.createDataFrame([(1, 5), (2, 1), (1, 4)], schema).write.mode("append").parquet(source)
    assert run() == {(1, 5), (2, 1)}
    spark.createDataFrame([(3, 7), (2, 9), (1, 2)], schema).write.mode("append").parquet(source)
    assert run() == {(1, 5), (2, 9), (3, 7)}
    assert run() == {(1, 5), (2, 9), (3, 7)}


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    events = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    rows = [(k, datetime.datetime(2024, 1, 1, k % 24), k % 3, "view", 1.0) for k in range(40)]
    spark.createDataFrame(rows, events).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")  # not read
    got = {name: QUERIES[name](spark, str(tmp_path)) for name in ("tumbling_counts", "change_feed_refresh", "stateful_rate_limit", "cache_outcomes")}
    assert got["tumbling_counts"].agg({"n": "sum"}).first()[0] == 40
    assert {tuple(r) for r in got["change_feed_refresh"].collect()} == {(0, 39), (1, 37), (2, 38)}
    assert got["stateful_rate_limit"].count() == got["cache_outcomes"].count() == 40


def test_a_long_group_comes_in_order_and_in_frames():
    rows = pd.DataFrame({"at": [k * 7919 % 12_007 for k in range(25_000)], "id": [2**60 + k for k in range(25_000)], "unused": "x"})
    frames = list(feeds.in_order(iter([rows[20_000:], rows[:20_000]]), ["at", "id"]))
    assert [len(f) for f in frames] == [feeds.FRAME, feeds.FRAME, 5_000]
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == sorted(zip(rows["at"], rows["id"]))
