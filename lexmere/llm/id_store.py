"""Content-addressed store of token ids.

A rolling hash over the last ids cuts each document's id stream into chunks, so that equal passages give equal chunks
wherever they stand. The store is two tables below one folder:

- ``chunks``: a row for each occurrence of a chunk (row, doc_id, pos, hash, n); the row of one of its occurrences also
  holds the ids as little-endian unsigned 16-bit integers. Each chunk is so stored once.
- ``recipes``: a row for each document in ascending doc_id order: its chunks' hashes, the number of its ids, the
  number of ids before it in its part, and the Merkle root of its hashes; ``manifest`` has a row for each part with its
  totals and the Merkle root of its documents' roots.

Chunks meet by hash once for each task that has met them; further occurrences in a task carry no ids and are dealt
evenly, so that a chunk that a third of all documents share stays one small row for each task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmere.llm.common import shared_dir
from lexmere.llm.encoding import Encoder, slices, word_encoder

END_ID = 2
#: Ids that the rolling hash covers, and bounds and mean of a chunk's ids.
SPAN, LEAST, MEAN, MOST = 16, 64, 256, 1024
#: Bytes of text encoded at once: of more text fewer pieces are looked up.
SLICE = 12 << 20
POLYNOMIAL = 0xEDB88320


def cuts(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document (of sizes[k] ids, one after the other), counted from its start.

    A chunk has LEAST ids at least, so that the ids of a document before never decide a cut.
    """
    h = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    step = 1
    while step < SPAN:  # h[i] = sum of the last SPAN ids' values, each shifted by its distance
        more = np.zeros_like(h)
        more[step:] = h[:-step] << np.uint32(step)
        h = h + more
        step *= 2
    marks = np.flatnonzero((h >> np.uint32(SPAN)) % np.uint32(MEAN) == 0) + 1
    ends = np.cumsum(sizes)
    first = np.searchsorted(marks, ends - sizes, side="right").tolist()
    last = np.searchsorted(marks, ends, side="left").tolist()
    marks, out = marks.tolist(), []
    for n, end, i, j in zip(sizes.tolist(), ends.tolist(), first, last, strict=True):
        own, at, start = [], 0, end - n
        for e in [*marks[i:j], end]:
            e -= start
            while e - at > MOST:
                at += MOST
                own.append(at)
            if e > at and (e - at >= LEAST or e == n):
                own.append(e)
                at = e
        out.append(own)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node moves up as it is."""
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0] if leaves else hashlib.sha256(b"").digest()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC's, in its reflected order."""
    a, out = a.copy(), np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where((b >> np.uint32(k)) & np.uint32(1), a, np.uint32(0))
        a = np.where(a & np.uint32(1), (a >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), a >> np.uint32(1))
    return out


def _zeros(n_bytes: np.ndarray) -> np.ndarray:
    """x ** (8 * n) for each n: what n more bytes multiply a CRC by."""
    out = np.full(len(n_bytes), 1 << 31, np.uint32)
    power = np.full(1, 1 << 23, np.uint32)  # x ** 8
    n = n_bytes.astype(np.int64)
    while n.any():
        out = np.where(n & 1, _times(out, np.broadcast_to(power, out.shape)), out)
        power = _times(power, power)
        n = n >> 1
    return out


def combine_crcs(crcs: np.ndarray, n_bytes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each document from those and the lengths of its chunks (sizes[k] of them, one document after the other):
    each chunk's CRC counts times what the bytes after it in its document multiply it by."""
    ends = np.cumsum(sizes)
    done = np.concatenate(([0], np.cumsum(n_bytes)))
    after = np.repeat(done[ends], sizes) - done[1:]
    parts = _times(crcs.astype(np.uint32), _zeros(after))
    out = np.zeros(len(sizes), np.uint32)
    if len(parts):
        out[sizes > 0] = np.bitwise_xor.reduceat(parts, (ends - sizes)[sizes > 0])
    return out


MANIFEST = "part long, n_docs long, n_tokens long, root binary"


def _manifest_row(pdf: pd.DataFrame) -> pd.DataFrame:
    """The totals of a part of the recipes and the Merkle root of its documents' roots."""
    pdf = pdf.sort_values("start_in_part")
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n_docs": [len(pdf)], "n_tokens": [pdf["n_tokens"].sum()], "root": [merkle_root(list(pdf["root"]))]})


def write_store(docs: DataFrame, path: str, encoder: Callable[[], Encoder] = word_encoder, end_id: int = END_ID) -> None:
    """Writes the ids of docs (doc_id, text), with end_id after each document, as a store below path.

    A null text is empty and has its end id alone. Repeated rows are documents of their own, next to each other; null
    identifiers come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    names = ["row", "doc_id", "pos", "hash", "n", "ids"]
    schema = f"row long, doc_id {kind}, pos int, hash binary, n int, ids binary"

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(), set()
        for b in batches:
            for at, n in slices(b.column(2), SLICE):
                source, out = [], []
                ids, sizes = enc.encode(b.column(2).slice(at, n), end_id)
                raw, first = ids.astype("<u2").tobytes(), 0
                for k, (size, ends) in enumerate(zip(sizes.tolist(), cuts(ids, sizes), strict=True), at):
                    start = 0
                    for p, end in enumerate(ends):
                        data = raw[2 * (first + start) : 2 * (first + end)]
                        h = hashlib.sha256(data).digest()
                        source.append(k)
                        out.append((p, h, end - start, None if h in seen else data))
                        seen.add(h)
                        start = end
                    first += size
                picked = pa.array(source, pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(picked), b.column(1).take(picked), *cols], names=names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hash, those with ids first: the ids of all but the first go."""
        before: tuple[bytes, bytes | None] = (b"", None)
        for b in batches:
            ids = b.column(5).to_pylist()
            for k, h in enumerate(b.column(3).to_pylist()):
                if ids[k] is None:
                    continue
                if before[0] == h:
                    if before[1] != ids[k]:
                        raise ValueError("equal hashes of different chunks")
                    ids[k] = None
                else:
                    before = (h, ids[k])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ids, pa.binary())], names=names)

    route = F.when(F.col("ids").isNotNull(), F.xxhash64("hash")).otherwise(F.xxhash64("row", "pos"))
    found = rows.mapInArrow(chunk, schema)
    dealt = found.repartition(route).sortWithinPartitions(F.col("hash"), F.col("ids").isNull())
    dealt.mapInArrow(once, schema).write.option("compression", "zstd").parquet(f"{path}/chunks")

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(2).to_numpy()
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            roots = [merkle_root(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(n), part, np.int64)), pa.array(starts), pa.array(roots, pa.binary())],
                names=["row", "doc_id", "n_tokens", "hashes", "part", "start_in_part", "root"],
            )

    chunks = spark.read.parquet(f"{path}/chunks")
    listed = chunks.groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("c"))
    listed = listed.select("row", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("c.hash").alias("hashes"))
    ordered = listed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    recipes = f"row long, doc_id {kind}, n_tokens long, hashes array<binary>, part long, start_in_part long, root binary"
    ordered.mapInArrow(part_of, recipes).write.parquet(f"{path}/recipes")

    parts = spark.read.parquet(f"{path}/recipes").select("part", "start_in_part", "n_tokens", "root").groupBy("part").applyInPandas(_manifest_row, MANIFEST)
    parts = parts.select("*", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("start"))  # a row for each part
    parts.write.parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over ids as little-endian unsigned 32-bit integers), verified, of each document.

    Every stored chunk is read and held against its address; each document's chunks are held against its Merkle root and
    length, and its checksum is put together from theirs by its recipe (read_ids puts ids together); each part's recipes
    are held against the manifest. What doesn't hold raises an error.
    """
    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null").select("hash", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, n = [], []
            for h, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if hashlib.sha256(ids).digest() != h:
                    raise ValueError("a chunk differs from its address")
                crc.append(zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
                n.append(len(ids) // 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["hash", "crc", "n"])

    digests = chunks.mapInArrow(digest, "hash binary, crc long, n long")
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = dict(recipes.dtypes)["doc_id"]
    uses = recipes.select("row", F.posexplode("hashes").alias("pos", "hash"))
    found = uses.join(digests, "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "crc", "n", "hash"))).alias("c"))
    found = found.select("row", F.col("c.crc").alias("crcs"), F.col("c.n").alias("ns"), F.col("c.hash").alias("found"))
    manifest = spark.read.parquet(f"{path}/manifest")
    parts = recipes.select("part", "start_in_part", "n_tokens", "root").groupBy("part").applyInPandas(_manifest_row, MANIFEST)
    both = parts.alias("f").join(manifest.alias("m"), "part", "full")
    if not both.where(" or ".join(f"not (f.{c} <=> m.{c})" for c in ("n_docs", "n_tokens", "root"))).isEmpty():
        raise ValueError("the recipes of a part differ from the manifest")
    manifest = manifest.select("part", F.col("start").alias("before"))
    each = recipes.drop("hashes").join(F.broadcast(manifest), "part").join(found, "row", "left")
    each = each.select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "root", "crcs", "ns", "found")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(5)
            sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            n = lists.flatten().to_numpy()
            sums = np.add.reduceat(np.append(n, 0), np.cumsum(sizes) - sizes) * (sizes > 0)
            if (sums != b.column(2).to_numpy()).any():
                raise ValueError("a document's chunks don't have its length")
            for root, hashes in zip(b.column(3).to_pylist(), b.column(6).to_pylist(), strict=True):
                if merkle_root(hashes or []) != root:
                    raise ValueError("a document differs from its manifest")
            crc = combine_crcs(b.column(4).flatten().to_numpy(), n * 4, sizes)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return each.mapInArrow(verify, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of the documents in wanted (doc_id), put together from the store."""
    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null").select("hash", "ids")
    recipes = spark.read.parquet(f"{path}/recipes").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    uses = recipes.select("row", "doc_id", F.posexplode("hashes").alias("pos", "hash")).join(chunks, "hash")
    whole = uses.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("c")).select("doc_id", F.col("c.ids").alias("parts"))
    kind = dict(whole.dtypes)["doc_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p), "<u2").astype(np.int32) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return whole.mapInArrow(join, f"doc_id {kind}, ids array<int>")


def op6_id_store(spark, sf_dir):
    path = shared_dir(spark, "ids")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read_index(spark, path)
