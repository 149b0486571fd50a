"""Structured Streaming: windowed counts, refresh from a change feed, and a rate limiter with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmere.functions.shared import shared_dir
from lexmere.plans.registry import Tables, query

SHORT_SECONDS, SHORT_CALLS, LONG_SECONDS, LONG_CALLS = 600, 3, 86_400, 10
#: Keys with state go by parts, so many hashes of them: a group of pandas takes milliseconds, however few rows it has, so
#: that a group for each key would take longer than its rows. Checkpoints hold for this number.
PARTS = 1024
#: Results leave a task in frames of so many rows.
FRAME = 10_000


def stream(spark: SparkSession, table: DataFrame, path: str) -> DataFrame:
    """A stream over a table, be it one Parquet file or a folder of them: a pattern may name either."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(table.schema).parquet(f"{folder}/{{{name}}}")


def run_to_end(out: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Processes all that is there and returns the table that it wrote. A restart goes on from the checkpoint."""
    q = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/out")


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts and sums of each event type and window; events later than ``late`` are left out."""
    w = F.window("ts", size)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def in_parts(rows: DataFrame, key: str) -> GroupedData:
    """rows grouped by parts, PARTS hashes of a key, for a function with state. Nulls are a key like any other."""
    return rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")).groupBy("part")


def without_nulls(*names: str) -> list[Column]:
    """Columns of numbers as 0 where they are null, and whether they are (no_<name>): pandas would make numbers inexact."""
    return [x for name in names for x in (F.coalesce(name, F.lit(0)).cast("long").alias(name), F.col(name).isNull().alias(f"no_{name}"))]


def with_nulls(rows: pd.DataFrame, name: str) -> pd.Series:
    """A column that without_nulls made, with its nulls."""
    return rows[name].astype("Int64").mask(rows[f"no_{name}"]) if rows[f"no_{name}"].any() else rows[name]


def in_order(batches: Iterator[pd.DataFrame], by: list[str], also: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    """Columns of a group's rows in order, as frames of a few rows each: the numbers are held at once, results are not."""
    rows = pd.concat([b[[*by, *also]] for b in batches], ignore_index=True)
    order = np.lexsort([rows[name].to_numpy() for name in reversed(by)])
    for k in range(0, len(order), FRAME):
        yield rows.iloc[order[k : k + FRAME]]


def limit_calls(calls: DataFrame) -> DataFrame:
    """calls (event_id, user_id, at seconds): accepted or not. A user gets 3 calls in 10 minutes and 10 in a day;
    rejected calls don't count, which is why the decision needs state. A call without a time is accepted and doesn't count.

    State is the accepted calls of each user of a part, those of the day before the last call."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        for rows in in_order(batches, ["no_user_id", "user_id", "no_at", "at", "no_event_id", "event_id"]):
            accepted = []
            for user, nobody, at, timeless in rows[["user_id", "no_user_id", "at", "no_at"]].itertuples(index=False, name=None):
                if timeless:
                    accepted.append(True)
                    continue
                user = None if nobody else user
                taken = [x for x in held.get(user, ()) if x > at - LONG_SECONDS]
                ok = len(taken) < LONG_CALLS and sum(x > at - SHORT_SECONDS for x in taken) < SHORT_CALLS
                if ok:
                    taken.append(at)
                held[user] = taken
                accepted.append(ok)
            yield pd.DataFrame({"event_id": with_nulls(rows, "event_id"), "user_id": with_nulls(rows, "user_id"), "accepted": accepted})
        state.update((list(held), list(held.values())))

    return in_parts(calls.select(*without_nulls("event_id", "user_id", "at")), "user_id").applyInPandasWithState(
        decide, "event_id long, user_id long, accepted boolean", "users array<long>, taken array<array<long>>", "append", GroupStateTimeout.NoTimeout
    )


def refresh(feed: DataFrame, path: str) -> DataFrame:
    """The latest revision of each title from a change feed: each batch merges its own into the version that the batch
    before has written and writes one of its own, named by its number. A batch that runs again gives the same version,
    and a restart from the same path goes on from the last one."""
    spark = feed.sparkSession
    version = lambda number: f"{path}/versions/number={number}"

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("title", "revision")
        if number:
            new = spark.read.parquet(version(number - 1)).unionByName(new)
        new.groupBy("title").agg(F.max("revision").alias("revision")).write.mode("overwrite").parquet(version(number))

    feed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        last = spark.read.parquet(f"{path}/versions").agg(F.max("number")).first()[0]
    except AnalysisException:  # no batch yet
        last = None
    return spark.createDataFrame([], "title long, revision long") if last is None else spark.read.parquet(version(last))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(t: Tables) -> DataFrame:
    events = stream(t.spark, t.events, f"{t.sf_dir}/events.parquet")
    w = F.window("ts", "1 hour")  # complete: all windows, late events too
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    path, done = shared_dir(t.spark, "windows"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")).write.mode("overwrite").parquet(f"{path}/v{number}")
        done.append(f"{path}/v{number}")

    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(done[-1]) if done else t.spark.createDataFrame([], "start timestamp_ntz, event_type string, n long, total double")


@query("SELECT user_id AS title, max(event_id) AS revision FROM events GROUP BY 1")
def change_feed_refresh(t: Tables) -> DataFrame:
    feed = stream(t.spark, t.events, f"{t.sf_dir}/events.parquet").select(F.col("user_id").alias("title"), F.col("event_id").alias("revision"))
    return refresh(feed, shared_dir(t.spark, "feed"))


@query()
def stateful_rate_limit(t: Tables) -> DataFrame:
    calls = stream(t.spark, t.events, f"{t.sf_dir}/events.parquet").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return run_to_end(limit_calls(calls), shared_dir(t.spark, "limits"))
