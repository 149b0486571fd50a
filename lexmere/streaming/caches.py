"""A cache with times to live as a stream with state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmere.functions.shared import shared_dir
from lexmere.plans.registry import Tables, query
from lexmere.streaming.feeds import in_order, in_parts, run_to_end, stream, with_nulls, without_nulls

#: How long an answer lives, in seconds: a week, a day, six hours, a quarter of an hour.
LIVES = (604_800, 86_400, 21_600, 900)


def cached_reads(reads: DataFrame, late: str = "1 hour", longest: int = max(LIVES)) -> DataFrame:
    """reads (read_id, entry, at timestamp, life seconds): whether each was answered from the cache, and the age of the
    answer (read_id, entry, hit, age).

    A read finds what the last miss has stored unless that is older than the read's life; a miss stores its answer anew.
    Reads of one time go by read_id, nulls last. State is one time for each entry of a part; entries that no read can find
    are dropped when their part is read again, a timer drops the whole part. That changes no outcome of reads that live for
    ``longest`` seconds, or for as long as an earlier one of their part. Reads of null entries or times don't count, nor do
    those later than ``late`` in a later batch.
    """

    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entries, times, most = state.get if state.exists else ((), (), longest)
        held = dict(zip(entries, times))
        for rows in in_order(batches, ["entry", "second", "no_read_id", "read_id"], ("life",)):
            hits, found = [], []
            for entry, second, life in rows[["entry", "second", "life"]].itertuples(index=False, name=None):
                stored = held.get(entry)
                hit = stored is not None and second - stored <= life
                if not hit:
                    held[entry] = stored = second
                hits.append(hit)
                found.append(stored)
            most = max(most, int(rows["life"].max()))
            yield pd.DataFrame({"read_id": with_nulls(rows, "read_id"), "entry": rows["entry"], "hit": hits, "age": rows["second"] - found})
        now = state.getCurrentWatermarkMs()
        last = (max(held.values()) + most + 1) * 1000
        held = {entry: stored for entry, stored in held.items() if (stored + most + 1) * 1000 > now}
        state.update((list(held), list(held.values()), most))
        state.setTimeoutTimestamp(max(last, now + 1))

    timed = reads.where("entry is not null and at is not null").withWatermark("at", late)
    timed = timed.select(*without_nulls("read_id"), "entry", "at", F.unix_seconds("at").alias("second"), F.coalesce("life", F.lit(0)).cast("long").alias("life"))
    return in_parts(timed, "entry").applyInPandasWithState(answer, "read_id long, entry long, hit boolean, age long", "entries array<long>, stored array<long>, longest long", "append", GroupStateTimeout.EventTimeTimeout)


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec FROM events),
f AS (SELECT user_id, min(sec) AS stored FROM e GROUP BY 1
      UNION ALL SELECT f.user_id, min(e.sec) FROM f JOIN e ON e.user_id = f.user_id AND e.sec > f.stored + 21600 GROUP BY f.user_id, f.stored),
r AS (SELECT e.event_id, e.user_id, e.sec, f.stored FROM e ASOF JOIN f ON e.user_id = f.user_id AND e.sec >= f.stored)
SELECT event_id AS read_id, user_id AS entry, NOT (sec = stored AND event_id = min(event_id) OVER (PARTITION BY user_id, sec)) AS hit, sec - stored AS age FROM r""")
def cache_outcomes(t: Tables) -> DataFrame:
    """Events as reads of their user's answer, which lives for six hours."""
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    reads = stream(t.spark, t.events, f"{t.sf_dir}/events.parquet").select(F.col("event_id").alias("read_id"), F.col("user_id").alias("entry"), at.alias("at"), F.lit(LIVES[2]).alias("life"))
    return run_to_end(cached_reads(reads, longest=LIVES[2]), shared_dir(t.spark, "cache"))
