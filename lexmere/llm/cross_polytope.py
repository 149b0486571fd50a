"""Approximate nearest neighbours by cross-polytope hashing.

In each table three rounds of random signs and a fast Hadamard transform turn the unit vectors; a vector's bucket is
the signed axis nearest to it. Queries probe the buckets of the axes nearest to them in every table. Queries and
candidates meet in blocks, are ranked by exact inner products, and each candidate is met in the first table only in
which the query probes its bucket. Buckets with many rows are dealt to several blocks, and queries that find too few
candidates are held against all rows in blocks: nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmere.llm.common import stage

K = 20
TABLES = 4
#: The share of the signed axes that a query probes in each table.
PROBES = 0.25
BLOCK = 2048
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row (length a power of two), scaled to keep norms."""
    n, m = x.shape
    h = 1
    while h < m:
        y = x.reshape(n, m // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, m)
        h *= 2
    return x / np.sqrt(m)


def rotated(x: np.ndarray, tables: int, seed: int = SEED) -> list[np.ndarray]:
    """Pseudo-rotations of the directions of x's rows, one for each table; rows are padded to a power of two."""
    m = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, m - x.shape[1])))
    rng = np.random.default_rng([seed, m])
    out = []
    for _ in range(tables):
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], m))
        out.append(y)
    return out


def buckets(y: np.ndarray) -> np.ndarray:
    axis = np.abs(y).argmax(axis=1)
    return axis * 2 + (y[np.arange(len(y)), axis] < 0)


def probed(y: np.ndarray, share: float) -> np.ndarray:
    """Which buckets each row probes: those of the signed axes nearest to it."""
    near = np.stack([y, -y], axis=2).reshape(len(y), 2 * y.shape[1])
    m = max(1, round(share * near.shape[1]))
    at = np.argpartition(-near, min(m, near.shape[1]) - 1, axis=1)[:, :m]
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, at, True, axis=1)
    return out


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, allowed: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best candidates by (inner product, smaller id): (query's position, ids, scores)."""
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ c.T
        bad = q_ids[i : i + 256, None] == c_ids[None, :]
        if allowed is not None:
            bad |= ~allowed[i : i + 256]
        s[bad] = -np.inf
        for j, row in enumerate(s):
            n = min(k, int(np.isfinite(row).sum()))
            if not n:
                continue
            least = np.partition(row, len(row) - n)[len(row) - n]
            at = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
            exact = (c[at] * q[i + j]).sum(axis=1)
            order = np.lexsort((c_ids[at], -exact))[:n]
            yield i + j, c_ids[at][order], exact[order]


def nearest(vectors: DataFrame, queries, k: int = K, tables: int = TABLES, probes: float = PROBES, block: int = BLOCK) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score.

    vectors: (vec_id, embedding); queries: a condition on vec_id that picks the queries among its rows. Rows whose id
    is null or whose vector is null, empty, zero or holds null or non-finite components take no part; repeated rows
    (same id and vector) count once; rows with the query's own id are no candidates; only vectors of one length are
    compared. A query with k or fewer candidates gets all of them. The hashes see directions: recall is meant for
    vectors of about equal norms, scores and order are exact for any. An empty table gives an empty result.
    """
    v = vectors.select("vec_id", "embedding")
    width = 4 if dict(v.dtypes)["embedding"] == "array<float>" else 8
    kind = f"<f{width}"
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).dropDuplicates()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists, query = b.column(0).to_numpy(), b.column(1), b.column(2).to_pylist()
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(ends)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = flat[ends[at][:, None] + np.arange(d)[None, :]]
                turned = rotated(x.astype(np.float64), tables)
                own = np.stack([buckets(y) for y in turned], axis=1).astype(np.int32)
                is_query = np.array([query[i] for i in at], bool)
                masks = np.stack([np.packbits(probed(y[is_query], probes), axis=1) for y in turned], axis=1)
                probe = iter(masks.reshape(len(masks), masks.shape[1] * masks.shape[2]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at], pa.int64()),
                        pa.array(np.full(len(at), d, np.int32)),
                        pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                        pa.array(list(own), pa.list_(pa.int32())),
                        pa.array([next(probe).tobytes() if yes else None for yes in is_query], pa.binary()),
                    ],
                    names=["vec_id", "dim", "v", "own", "probe"],
                )

    is_query = F.coalesce(queries(F.col("vec_id")), F.lit(False))
    rows = v.select(F.col("vec_id").cast("long"), "embedding", is_query.alias("q"))
    rows = stage(rows.mapInArrow(hashed, "vec_id long, dim int, v binary, own array<int>, probe binary"), "hashed")

    # A bucket's blocks: the table of sizes has a row for each table and signed axis.
    by_table = rows.select("vec_id", "dim", "v", "own", F.posexplode("own").alias("t", "b"))
    sizes = by_table.groupBy("dim", "t", "b").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = F.broadcast(stage(sizes, "sizes"))
    left = by_table.join(sizes, ["dim", "t", "b"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    left = left.select("dim", "t", "b", "block", "vec_id", "v", "own")

    def probes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per = [np.unpackbits(np.frombuffer(p, np.uint8)).reshape(tables, -1) for p in b.column(3).to_pylist()]
            for i in range(0, len(per), 256):
                row, t, bucket = np.nonzero(np.stack(per[i : i + 256]))
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(at), pa.array(t.astype(np.int32)), pa.array(bucket.astype(np.int32)), b.column(0).take(at), b.column(2).take(at), b.column(3).take(at)],
                    names=["dim", "t", "b", "query_id", "v", "probe"],
                )

    asked = rows.where("probe is not null").select("vec_id", "dim", "v", "probe")
    right = asked.mapInArrow(probes_of, "dim int, t int, b int, query_id long, v binary, probe binary")
    right = right.join(sizes, ["dim", "t", "b"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    out_schema = "query_id long, q binary, vec_id long, score double"

    def result(q_ids: list, q_raw: list, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
        at, ids, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, x, s in found:
            at += [i] * len(x)
            ids.append(x)
            scores.append(s)
        return pa.table({"query_id": pa.array([q_ids[i] for i in at], pa.int64()), "q": pa.array([q_raw[i] for i in at], pa.binary()), "vec_id": np.concatenate(ids).astype(np.int64), "score": np.concatenate(scores)})

    def matrix(raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)

    def meet(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        c_ids, q_ids, q_raw = candidates.column("vec_id").to_numpy(), asking.column("query_id").to_numpy(), asking.column("v").to_pylist()
        if not len(c_ids) or not len(q_ids):
            return result([], [], iter(()))
        t = candidates.column("t")[0].as_py()
        own = np.array(candidates.column("own").to_pylist())
        probe = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in asking.column("probe").to_pylist()]), axis=1).reshape(len(q_ids), tables, -1).astype(bool)
        first = np.ones((len(q_ids), len(c_ids)), bool)
        for earlier in range(t):
            first &= ~probe[:, earlier, :][:, own[:, earlier]]
        return result(q_ids.tolist(), q_raw, best(matrix(q_raw), q_ids, matrix(candidates.column("v").to_pylist()), c_ids, first, k))

    key = ["dim", "t", "b", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, out_schema)
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    top = stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")

    # Queries that found fewer than there are: against all rows, block by block.
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    got = top.groupBy("query_id", "q").agg(F.count(F.lit(1)).alias("got"))
    short = asked.select(F.col("vec_id").alias("query_id"), "dim", F.col("v").alias("q")).join(F.broadcast(counts), "dim").join(got, ["query_id", "q"], "left")
    short = stage(short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("query_id", "dim", "q", "n"), "short")
    if not short.isEmpty():
        blocks = F.ceil(F.col("n") / block).cast("int")
        all_rows = rows.join(F.broadcast(counts), "dim").select("dim", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), "vec_id", "v")
        asking = short.select("dim", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "query_id", F.col("q").alias("v"))

        def meet_all(candidates: pa.Table, asking: pa.Table) -> pa.Table:
            c_ids, q_ids, q_raw = candidates.column("vec_id").to_numpy(), asking.column("query_id").to_numpy(), asking.column("v").to_pylist()
            if not len(c_ids) or not len(q_ids):
                return result([], [], iter(()))
            return result(q_ids.tolist(), q_raw, best(matrix(q_raw), q_ids, matrix(candidates.column("v").to_pylist()), c_ids, None, k))

        exact = all_rows.groupBy("dim", "block").cogroup(asking.groupBy("dim", "block")).applyInArrow(meet_all, out_schema)
        exact = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.join(short.select("query_id", "q"), ["query_id", "q"], "left_anti").unionByName(exact)
    return top.select("query_id", "rank", "vec_id", "score")


def op8_cross_polytope(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, lambda vec_id: vec_id % 20 == 0)
