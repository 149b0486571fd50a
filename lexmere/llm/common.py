"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in the bitmap of a set of keys: 2 MB of bits, told to every task.
WORDS = 1 << 18
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty string."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir, or that the session has as its
    checkpoint folder. A session without either, as in tests, gets one of its own if it has no executors apart; else an
    error is raised."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="lexmere-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/lexmere-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back: this cuts lineage and outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_by_keys(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits rows into (surely not, perhaps) among keys (column h, long; of a hash): by a bitmap of fixed size.

    Neither part is shuffled, so that only the second, a small one unless the keys fill the bitmap, has to meet the keys
    themselves. Null keys count as perhaps. Rows may have any columns.
    """
    at = "__"
    while any(c.lower().startswith(at) for c in rows.columns):  # names that no column of rows has
        at += "_"
    bit = lambda h: F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")
    bits = keys.select(F.pmod(F.col("h"), F.lit(WORDS)).alias(f"{at}word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit("h")).alias(f"{at}bits"))
    bits = F.broadcast(stage(bits.groupBy(f"{at}word").agg(F.bit_or(f"{at}bits").alias(f"{at}bits")), "bitmap"))
    names = [F.col(f"`{c}`") for c in rows.columns]
    met = rows.withColumn(f"{at}h", key).join(bits, F.pmod(F.col(f"{at}h"), F.lit(WORDS)) == F.col(f"{at}word"), "left")
    perhaps = F.col(f"{at}h").isNull() | (F.getbit(F.coalesce(f"{at}bits", F.lit(0).cast("long")), bit(f"{at}h")) == 1)
    return met.where(~perhaps).select(*names), met.where(perhaps).select(*names)
