"""Language-model scoring by context-tree weighting over bytes.

A document is read as its words (lower-cased A-Z, single spaces between) and a final end byte. Each byte is eight
binary decisions; each decision has a tree of contexts, the last 0 to ``DEPTH`` bytes, whose nodes hold
Krichevsky-Trofimov counts from all training documents. A node weighs its own estimate against its children's by the
probability that each gives to the training data, and a prediction mixes the estimates of all depths along its path.
Where training never met a deeper context, the deepest one that it met decides.

The model is nowhere whole. Documents are blocked into chunks; each chunk sends the distinct byte strings (context and
byte) and words that it holds, with their training counts, to buckets by hash; buckets add them up; the trees are
weighted in groups by the last two bytes (what lies above, at most 256 x 256 nodes, goes through the driver); and each
chunk gets back the probabilities and counts of exactly the strings that it asked for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.common import stage

DEPTH = 5
#: Text bytes in a block (a row), in a chunk (blocks that ask together) and for each bucket.
BLOCK, CHUNK, BUCKET = 1 << 20, 16 << 20, 24 << 20
END = b"\n"
LN2 = math.log(2)


def canonical(text: str | None) -> bytes:
    """Words with single spaces between; never holds the end byte."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def strings(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte with its context, and how many each document has (its bytes and the end).

    A key holds the DEPTH bytes before, the nearest first, and the byte itself, one to each eight bits. Before a
    document stand end bytes.
    """
    pad = END * DEPTH
    a = np.frombuffer(b"".join([pad + d + END for d in docs]), np.uint8)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    starts = np.cumsum(sizes + DEPTH) - sizes
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    key = a[at].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key |= a[at - d].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    return key, sizes


def spread(keys: np.ndarray, n: int) -> np.ndarray:
    """A bucket of each key."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def squeeze(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def numbers(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(numbers(raw, "<u8"), dtype=np.uint64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their numbers."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its keys in order)."""
    of = spread(keys, n)
    order = np.argsort(of, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(part):
            yield int(of[part[0]]), part


def half_gamma(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for counts n."""
    small = np.concatenate(([0.5 * math.log(math.pi)], np.log(np.arange(64) + 0.5))).cumsum()
    x = np.maximum(n, 1) + 0.5
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 64, small[np.minimum(n, 63).astype(np.int64)], large)


def log_gamma(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1) for counts n."""
    small = np.concatenate(([0.0], np.log(np.arange(1, 64)))).cumsum()
    x = np.maximum(n, 1) + 1.0
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 64, small[np.minimum(n, 63).astype(np.int64)], large)


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return half_gamma(a) + half_gamma(b) - log_gamma(a + b) - math.log(math.pi)


def weigh(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own - LN2, children - LN2)


def share(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The node's own share of the mixture that it predicts with."""
    return 0.5 * (1 + np.tanh((own - children) / 2))


class Level:
    """The nodes of one depth: (context, bits of the byte so far) with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        context, byte = keys >> np.uint64(48 - 8 * depth), keys & np.uint64(0xFF)
        pairs, at = np.unique((context << np.uint64(8)) | byte, return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(pairs))
        byte, high = (pairs & np.uint64(0xFF)).astype(np.int64), pairs & ~np.uint64(0xFF)
        bits = np.arange(8)[:, None]
        so_far = (1 << bits) | (byte[None, :] >> (8 - bits))
        self.bit = (byte[None, :] >> (7 - bits)) & 1
        self.nodes, self.at = np.unique((high[None, :] | so_far.astype(np.uint64)).ravel(), return_inverse=True)
        self.at = self.at.reshape(8, -1)
        w = np.broadcast_to(n, self.bit.shape)
        self.b = np.bincount(self.at.ravel(), weights=(w * self.bit).ravel(), minlength=len(self.nodes))
        self.a = np.bincount(self.at.ravel(), weights=(w * (1 - self.bit)).ravel(), minlength=len(self.nodes))
        self.own = log_estimate(self.a, self.b)

    def parents(self, above: Level | None) -> np.ndarray:
        """Positions of the parents among above's nodes, or the parents themselves."""
        up = ((self.nodes >> np.uint64(16)) << np.uint64(8)) | (self.nodes & np.uint64(0xFF))
        return np.searchsorted(above.nodes, up) if above else up.astype(np.int64)


def levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Depths 2 to DEPTH with the sums of their children's weighted logs, from the bottom up."""
    out = [Level(keys, counts, d) for d in range(2, DEPTH + 1)]
    for k in range(len(out) - 1, -1, -1):
        x = out[k]
        if k == len(out) - 1:
            x.children, x.log = x.own, x.own
        else:
            x.children = np.bincount(out[k + 1].parents(x), weights=out[k + 1].log, minlength=len(x.nodes))
            x.log = weigh(x.own, x.children)
    return out


class Top:
    """Depths 0 and 1, from the sums over depth 2: node = last byte * 256 + bits so far."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        a, b, log = (np.zeros(65536) for _ in range(3))
        for node, x, y, z in rows:
            a[node], b[node], log[node] = x, y, z
        own = log_estimate(a, b)
        a0, b0 = a.reshape(256, 256).sum(axis=0), b.reshape(256, 256).sum(axis=0)
        children0 = weigh(own, log).reshape(256, 256).sum(axis=0)
        w0, kt0 = share(log_estimate(a0, b0), children0), (b0 + 0.5) / (a0 + b0 + 1)
        self.mixed, self.rest, self.last = descend((np.zeros(256), np.ones(256), np.full(256, 0.5)), a0, b0, w0, kt0)
        above = tuple(np.tile(x, 256) for x in (self.mixed, self.rest, self.last))
        self.mixed, self.rest, self.last = descend(above, a, b, share(own, log), (b + 0.5) / (a + b + 1))


def descend(above: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, w: np.ndarray, kt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mixed, rest, last) of nodes from their parents': the estimates mixed so far, the weight that is left for deeper
    ones, and the prediction if the path ends here. Nodes without training counts predict as their parents do."""
    mixed, rest, last = above
    end = mixed + rest * kt
    met = a + b > 0
    return np.where(met, mixed + rest * w * kt, last), np.where(met, rest * (1 - w), 0.0), np.where(met, end, last)


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 P(byte | context) of each key."""
    tree = levels(keys, counts)
    above = top
    for k, x in enumerate(tree):
        at = x.parents(tree[k - 1] if k else None)
        above = descend(tuple(y[at] for y in above), x.a, x.b, share(x.own, x.children), (x.b + 0.5) / (x.a + x.b + 1))
    leaf = tree[-1]
    p = above[2][leaf.at]
    return np.log10(np.where(leaf.bit == 1, p, 1 - p)).sum(axis=0)


def blocked(docs: DataFrame) -> DataFrame:
    """(chunk, ids, held, texts): blocks of canonical texts, compressed."""
    kind = dict(docs.dtypes)["doc_id"]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size, total, part = [], [], [], 0, 0, None
        squeeze = zstandard.ZstdCompressor(level=3)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part + total // CHUNK], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([squeeze.compress(END.join(texts))], pa.binary())],
                names=["chunk", "ids", "held", "texts"],
            )

        for b in batches:
            id_type = b.schema.field(1).type
            for row, i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                part = (row >> 33) << 24
                text = canonical(t.as_py())
                ids.append(i)
                held.append(h)
                texts.append(text)
                size += len(text) + 1
                if size >= BLOCK:
                    yield out()
                    total += size
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held"), "text")
    return stage(rows.mapInArrow(block, f"chunk long, ids array<{kind}>, held array<boolean>, texts binary"), "blocks")


def texts_of(raw: bytes, n: int) -> list[bytes]:
    texts = zstandard.ZstdDecompressor().decompress(raw).split(END)
    if len(texts) != n:
        raise ValueError("a block's texts don't match its ids")
    return texts


def asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, chunk, keys, counts): what each chunk's documents hold, with counts over its training documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, grams, words = None, [], Counter()

        def out() -> Iterator[pa.RecordBatch]:
            w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            for kind, parts in (("gram", grams), ("word", [(w, np.fromiter(words.values(), np.int64, len(words)))])):
                keys, n = merged(parts)
                rows = [(kind, b, chunk, pack_keys(keys[at]), squeeze(n[at].astype("<u4"))) for b, at in by_bucket(keys, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                        names=["kind", "bucket", "chunk", "keys", "counts"],
                    )

        for b in batches:
            for c, held, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c != chunk and chunk is not None:
                    yield from out()
                    grams, words = [], Counter()
                chunk = c
                texts = texts_of(raw, len(held))
                for train in (True, False):
                    part = [t for t, h in zip(texts, held, strict=True) if h != train]
                    if not part:
                        continue
                    keys, n = np.unique(strings(part)[0], return_counts=True)
                    grams.append((keys, n if train else np.zeros(len(n), np.int64)))
                    for t in part:
                        if not t:
                            continue
                        if train:
                            words.update(t.split(b" "))
                        else:
                            for x in t.split(b" "):
                                words.setdefault(x, 0)
                if len(grams) > 8:
                    grams = [merged(grams)]
        if chunk is not None:
            yield from out()

    return blocks.select("chunk", "held", "texts").mapInArrow(ask, "kind string, bucket long, chunk long, keys binary, counts binary")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row of docs
    (doc_id, text).

    Learns from rows whose crc32(doc_id) mod 10 is not 0 (and those with a null doc_id). Tokens are words and one end;
    base_score is the smoothed unigram's log10 probability; score is the context trees' log10 probability of the
    words, the spaces between them and the end, and bits_per_byte its code length. A null text is empty. Repeated rows
    count and are scored as often as they occur. Without training rows every bit has probability 1/2. An empty table
    gives an empty result. Words are counted by their 64-bit hash.
    """
    kind = dict(docs.dtypes)["doc_id"]
    blocks = blocked(docs.select("doc_id", "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET))
    groups = 2 * buckets
    requests = stage(asked(blocks, buckets), "requests")

    def add_up(t: pa.Table) -> pa.Table:
        kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
        parts = [(unpack_keys(k), numbers(n, "<u4").astype(np.int64)) for k, n in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True)]
        keys, n = merged(parts)
        rows = []
        if kind == "word":
            rows.append(("total", bucket, b"", b"", int(n.sum()), int((n > 0).sum())))
            for chunk, (k, _) in zip(t.column("chunk").to_pylist(), parts, strict=True):
                rows.append(("word", chunk, pack_keys(k), squeeze(n[np.searchsorted(keys, k)].astype("<f8")), 0, 0))
        else:
            of = spread(keys >> np.uint64(32), groups)
            order = np.argsort(of, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                rows.append(("gram", int(of[at[0]]), pack_keys(keys[at]), squeeze(n[at].astype("<f8")), 0, 0))
        types = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(v, x) for c, v, x in zip(("kind", "at", "keys", "numbers", "n", "v"), zip(*rows, strict=True), types, strict=True)})

    sums = requests.groupBy("kind", "bucket").applyInArrow(add_up, "kind string, at long, keys binary, numbers binary, n long, v long")
    sums = stage(sums, "sums")

    def grams(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return merged([(unpack_keys(k), numbers(n, "<f8")) for k, n in zip(t.column("keys").to_pylist(), t.column("numbers").to_pylist(), strict=True)])

    def tops(t: pa.Table) -> pa.Table:
        x = levels(*grams(t))[0]
        node, at = np.unique(x.parents(None), return_inverse=True)
        return pa.table({"node": node, **{c: np.bincount(at, weights=w) for c, w in (("a", x.a), ("b", x.b), ("log", x.log))}})

    trees = sums.where("kind = 'gram'").select("at", "keys", "numbers")
    upper = trees.groupBy("at").applyInArrow(tops, "node long, a double, b double, log double").groupBy("node").agg(F.sum("a"), F.sum("b"), F.sum("log"))
    top = Top([tuple(r) for r in upper.collect()])  # 65,536 rows at most
    above = (top.mixed, top.rest, top.last)

    def solve(t: pa.Table) -> pa.Table:
        keys, n = grams(t)
        p = log10_probabilities(keys, n, above)
        rows = [(b, pack_keys(keys[at]), squeeze(p[at].astype("<f8"))) for b, at in by_bucket(keys, buckets)]
        return pa.table({c: pa.array(v, x) for c, v, x in zip(("bucket", "keys", "p"), zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)})

    model = trees.groupBy("at").applyInArrow(solve, "bucket long, keys binary, p binary")

    def answer(asking: pa.Table, model: pa.Table) -> pa.Table:
        parts = [(unpack_keys(k), numbers(p, "<f8")) for k, p in zip(model.column("keys").to_pylist(), model.column("p").to_pylist(), strict=True)]
        keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)])
        order = np.argsort(keys)
        keys, p = keys[order], np.concatenate([p for _, p in parts] or [np.zeros(0)])[order]
        found = [squeeze(p[np.searchsorted(keys, unpack_keys(k))].astype("<f8")) for k in asking.column("keys").to_pylist()]
        return pa.table({"kind": pa.array(["gram"] * len(found), pa.string()), "at": asking.column("chunk"), "keys": asking.column("keys"), "numbers": pa.array(found, pa.binary())})

    asking = requests.where("kind = 'gram'").select("bucket", "chunk", "keys")
    answers = asking.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, "kind string, at long, keys binary, numbers binary")
    answers = answers.unionByName(sums.where("kind = 'word'").select("kind", "at", "keys", "numbers"))

    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        tables = {}
        for kind in ("gram", "word"):
            parts = [(unpack_keys(k), numbers(n, "<f8")) for c, k, n in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "numbers")), strict=True) if c == kind]
            keys, at = np.unique(np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)]), return_index=True)
            tables[kind] = keys, np.concatenate([n for _, n in parts] or [np.zeros(0)])[at]
        keys, p = tables["gram"]
        word_keys, counts = tables["word"]
        logs = np.log10(counts + 0.1)
        known: dict[bytes, float] = {}
        cols: dict[str, list] = {c: [] for c in ("words", "known", "logs", "score", "n_bytes")}
        for n, raw in zip(map(len, blocks.column("held").to_pylist()), blocks.column("texts").to_pylist(), strict=True):
            texts = texts_of(raw, n)
            key, sizes = strings(texts)
            cols["score"].append(np.add.reduceat(p[np.searchsorted(keys, key)], np.cumsum(sizes) - sizes))
            cols["n_bytes"].append(sizes)
            split = [t.split(b" ") if t else [] for t in texts]
            new = [w for w in set().union(*split) if w not in known]
            at = np.searchsorted(word_keys, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)))
            known.update(zip(new, logs[at].tolist(), strict=True))
            each = [np.fromiter(map(known.__getitem__, s), np.float64, len(s)) for s in split]
            cols["words"].append(np.array([len(x) for x in each], np.int64))
            cols["known"].append(np.array([(x > 0).sum() for x in each], np.int64))
            cols["logs"].append(np.array([x.sum() for x in each]))
        ids = pa.concat_arrays([c.flatten() for c in blocks.column("ids").chunks]) if blocks.num_rows else pa.array([], blocks.schema.field("ids").type.value_type)
        held = pa.concat_arrays([c.flatten() for c in blocks.column("held").chunks]) if blocks.num_rows else pa.array([], pa.bool_())
        flat = {c: np.concatenate(v) if v else np.zeros(0) for c, v in cols.items()}
        return pa.table({"doc_id": ids, "held_out": held, **{c: pa.array(v, pa.float64() if c in ("logs", "score") else pa.int64()) for c, v in flat.items()}})

    schema = f"doc_id {kind}, held_out boolean, words long, known long, logs double, score double, n_bytes long"
    scored = blocks.groupBy("chunk").cogroup(answers.withColumnRenamed("at", "chunk").groupBy("chunk")).applyInArrow(score, schema)
    totals = sums.where("kind = 'total'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    ends = docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))).agg(F.count(F.lit(1)).alias("ends"))
    n, v, ends = *totals.first(), ends.first()[0]
    train, distinct = n + ends, v + (ends > 0)
    spread_log = math.log10(train + 0.1 * (distinct + 1))
    return scored.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 0.1) - (F.col("words") + 1) * spread_log).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op3_context_tree(spark, sf_dir):
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
