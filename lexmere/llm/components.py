"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.common import stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component is the smallest node that it reaches.

    Each round writes its edges to the shared folder; the driver sees two numbers a round. A star keeps one edge for
    each of its nodes, so a hub's neighbours stay as many rows as it has edges and are only ever grouped by minimum,
    which Spark pre-aggregates.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        edges = stage(small.distinct(), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
