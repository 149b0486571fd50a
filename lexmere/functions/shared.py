"""Tables that a query writes on its way, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that says to which part a row is dealt.
DEALT = "__dealt"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir, or that the session has for checkpoints.
    A local session without either, as in tests, gets one of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="lexmere-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/lexmere-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back: what follows doesn't compute it again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str = "law") -> DataFrame:
    """df dealt out by the hash of a key, with its part as DEALT; one that has this column is dealt already. Joins, windows
    and groups whose keys begin with DEALT find their rows in place: they move nothing."""
    if DEALT in df.columns:
        return df
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(DEALT, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartitionById(n, DEALT)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches in short ones without a copy, so that a task holds a few long texts as Python's strings, not ten thousand."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
