"""Exact dedup by a tree-merge of sorted digest runs.

Every row joins one of ``2 ** (bits * rounds)`` leaf runs. A run is sorted by digest and holds one entry for each: its best
identifier, its number of rows and the extremes of a second fingerprint. Rounds follow a binomial tree, ``bits`` of its
levels at a time: a run goes to the one whose number has the next bits cleared, where the runs that arrive are merged in
sorted order and the entries of one digest, one a run, are verified and become one. A digest that holds a third of all
rows so never weighs more than the number of runs. The root's entries then go down to the leaves again, and rows meet
them in their own leaf. Only digests and identifiers move, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmere.llm.common import ascii_lower, split_by_keys, stage

BITS, ROUNDS = 4, 3


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, check, n_bytes) of every row; check is a second, independent fingerprint."""
    norm = ascii_lower(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
    )


def tree_merge(entries: DataFrame, bits: int = BITS, rounds: int = ROUNDS) -> DataFrame:
    """Merges the leaf runs' entries (run, digest, best, n, lo, hi) to one entry (digest, best, n) for each digest.

    The second fingerprint is compared at every level: entries of one digest with different ones raise an error
    rather than merge.
    """
    for k in range(rounds):
        receiver = F.expr(f"run & ~{(1 << bits * (k + 1)) - 1}")
        digest = Window.partitionBy("run", "digest").orderBy(F.desc_nulls_last("best"))  # 2 ** bits entries at most
        group = digest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        entries = (
            entries.withColumn("run", receiver)
            .select("run", "digest", "best", F.sum("n").over(group).alias("n"), F.min("lo").over(group).alias("lo"), F.max("hi").over(group).alias("hi"), F.row_number().over(digest).alias("place"))
            .where("place = 1")
            .withColumn("n", F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(F.raise_error(F.lit("equal digests of different texts")).cast("long")))
            .drop("place")
        )
    return entries.select("digest", "best", "n")


def leaf_runs(rows: DataFrame, sign: int = 1) -> DataFrame:
    """The leaf runs' entries (run, digest, best, n, lo, hi): each run is whole in one partition, and so in one file once it
    is written, in order of digest. Runs are dealt by identifier, so that none is larger than others whatever a digest's
    share of the rows."""
    entries = rows.repartition("run").groupBy("run", "digest").agg(
        F.max(F.col("doc_id") * sign).alias("best"), F.sum("copies").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return entries.sortWithinPartitions("run", "digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", bits: int = BITS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest (keep="max") or smallest (keep="min") identifier stays; null identifiers stay only where a group has no
    other. Of repeated rows (same identifier, same text) exactly one is kept. An empty table gives an empty result.
    Other columns of docs are ignored.
    """
    sign = 1 if keep == "max" else -1
    rows = (
        digest_rows(docs, id_col, text_col)
        .withColumn("run", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << bits * rounds)).cast("int"))
        .groupBy("run", "digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("n_bytes").alias("n_bytes"))
    )
    rows = stage(rows, "digests")
    leaves = stage(leaf_runs(rows, sign), "runs")
    root = tree_merge(leaves, bits, rounds)
    down = leaves.select("run", "digest").join(root, "digest")
    out = rows.join(down, ["run", "digest"])
    return out.select(
        "doc_id",
        (F.col("best") * sign).alias("keep_id"),
        F.col("n").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_bytes",
        "digest",
    ).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_bytes", "digest"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of equal texts one row, as exact_groups says.

    Null texts count as empty and so form one group; a null identifier stays only where its group has no other. Of
    repeated rows one stays. An empty table gives an empty result; any column but ``__digest`` may occur.
    Rows that no copy can be among, told by a bitmap of identifiers, stay where they are; the texts of the others are
    shuffled.
    """
    groups = exact_groups(docs, id_col, text_col, keep).where("group_size > 1").select("doc_id", "kept", "digest")
    met = groups.groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows")).where("not stays or rows > 1")
    met = stage(met.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__met"), "stays"), "copies")
    apart, near = split_by_keys(docs, F.xxhash64(F.col(id_col)), met.select(F.xxhash64("__id").alias("h")))
    near = near.withColumn("__digest", F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)))
    same = near[id_col].eqNullSafe(met["__id"]) & (near["__digest"] == met["__met"])
    kept = near.join(met, same, "left_anti")
    if not met.where("stays").isEmpty():  # repeated rows: one of each stays
        kept = kept.unionByName(near.join(met.where("stays"), same, "left_semi").dropDuplicates([id_col, "__digest"]))
    return apart.unionByName(kept.drop("__digest"))


def op5_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
