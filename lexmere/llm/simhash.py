"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so that pairs within ``max_bits`` lie within
``max_bits`` of each other in the embedding. The vector is cut into ``max_bits // 2 + 1`` groups of segments: at least
one group then differs by 1 at most. Each group is a grid whose cells are its bit counts; fingerprints meet in a
range join over the cell and its neighbours at distance 1, are filtered by the lower bound and verified exactly.

Equal fingerprints are one row throughout, so that a group of copies costs as much as a single document.

The pipeline's stage asks for more: pairs whose sets of five-word shingles overlap by 0.8 or more. Such pairs differ in
about ten bits, a radius that no grid over 64 bits carries. So candidates come from the grid and from shingles that two
documents share among their first fifth in one global order, which every such pair does. Of these pairs, those of sizes
that can't overlap so far go, and the others are checked exactly; no bound on fingerprints decides here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.llm.common import split_by_keys, stage
from lexmere.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 32
WIDTH = 64 // SEGMENTS
#: The pipeline's stage: words of a shingle, and the overlap (shared over all shingles) as numerator and denominator.
STAGE_SHINGLE = 5
OVERLAP = (4, 5)
#: One in so many documents (but at least that number of them) has its shingles counted to find common ones; how many of
#: these are told to tasks. They decide what work is done, never which pairs are found.
ORDER_SHARE, ORDER_DOCS, ORDER_SHINGLES = 8, 8_000, 1 << 18
#: Parts that documents with a common shingle are dealt to.
SALTS = 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence where it has fewer words; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Words are runs of non-space bytes after lower-casing A-Z; a bit is set if set in over half the shingles' XXH64
    (repeats included). Fewer words than a shingle: the whole sequence; none: zero."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(each, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def segment_counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))) for k in range(SEGMENTS)]


def near_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in fps (fp) that differ in max_bits bits at most.

    A cell holds its group's bit counts, a digit each. Both fingerprints of a pair look the grid up: one side by
    its own cell, the other by its cell and the neighbours at distance 1.
    """
    groups = max_bits // 2 + 1
    per, base = SEGMENTS // groups, WIDTH + 1
    parts = [range(g * per, SEGMENTS if g == groups - 1 else (g + 1) * per) for g in range(groups)]
    def cell(g: int) -> Column:
        own = F.lit(g).cast("long")
        for k in parts[g]:
            own = own * base + F.col("v")[k]
        return own

    def around(g: int) -> Column:
        """The cell, and the cells where one segment has one bit more or less."""
        steps = F.array(*[F.lit(base ** (parts[g][-1] - k)).cast("long") for k in parts[g]])
        counts = F.slice("v", parts[g][0] + 1, len(parts[g]))
        moved = F.zip_with(counts, steps, lambda n, s: F.array(F.when(n < WIDTH, s), F.when(n > 0, -s)))
        return F.concat(F.array(F.col("cells")[g]), F.transform(F.array_compact(F.flatten(moved)), lambda s: F.col("cells")[g] + s))

    embedded = fps.select("fp", F.array(*segment_counts(F.col("fp"))).alias("v"))
    embedded = stage(embedded.select("fp", "v", F.array(*[cell(g) for g in range(groups)]).alias("cells")), "embedding")
    own = embedded.select(F.col("fp").alias("a"), F.explode("cells").alias("cell"))
    near = embedded.select(F.col("fp").alias("b"), F.explode(F.concat(*[around(g) for g in range(groups)])).alias("cell"))
    bound = sum((F.abs(x - y) for x, y in zip(segment_counts(F.col("a")), segment_counts(F.col("b")), strict=True)), F.lit(0))
    pairs = own.join(near, "cell").where((F.col("a") < F.col("b")) & (bound <= max_bits))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b").distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, links.

    Fingerprints link at max_bits or fewer differing bits; component_id is the smallest doc_id reachable over links.
    links counts the other fingerprints within reach of the row's own. Null texts count as empty and have, like texts
    without words, fingerprint zero; a null doc_id takes part by its fingerprint and never names a component unless
    all of its component are null. Repeated rows give repeated rows; an empty table an empty result; other columns are
    ignored.
    """
    rows = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    of = classes(rows, max_bits)
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")


def classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component, component_id, links) of each fingerprint in rows (doc_id, fp); component is a fingerprint."""
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    pairs = stage(near_pairs(nodes.select("fp"), max_bits), "pairs")
    comp = connected_components(pairs).withColumnRenamed("node", "fp")
    degree = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    linked = stage(nodes.join(comp, "fp").join(degree, "fp"), "linked")
    best = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(best, "component").select("fp", "component", "component_id", "links")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("least").alias("component_id"), F.lit(0).cast("long").alias("links"))
    return stage(linked.union(alone), "classes")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document for each component of near_groups; see keep_one."""
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("row"), "text")
    rows = stage(fingerprints(rows, shingle, "row"), "fingerprints")
    return keep_one(docs, rows.join(classes(rows, max_bits), "fp").select("doc_id.doc_id", "doc_id.key", "component"))


def text_key() -> Column:
    """What a document is told by in the stage: a hash of its text. Texts of one hash would count as one."""
    return F.xxhash64("text")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the distinct texts in docs: the sorted set of shingles."""
    rows = docs.select(text_key().alias("node"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists(sets)], names=["node", "shingles"])

    return rows.mapInArrow(each, "node long, shingles array<long>").dropDuplicates(["node"])


def lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that occur in two or more documents of a sample, commonest last."""
    share = min(1.0, max(1 / ORDER_SHARE, ORDER_DOCS / max(docs.count(), 1)))
    some = docs.where(F.pmod(text_key(), F.lit(1 << 20)) < share * (1 << 20))
    counts = shingle_sets(some, shingle).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).select("s").toArrow().column(0).to_numpy()[::-1].copy()


def sketches(docs: DataFrame, shingle: int, common: np.ndarray) -> DataFrame:
    """(node, fp, n, first, hot) of every row: the fingerprint of the set of shingles, its size, and the first
    n - ceil(0.8 n) + 1 shingles, first those that aren't common, then those that are (hot), commonest last.

    Two sets that overlap by 0.8 share one of these whatever the order is, as long as it is one for all sets.
    """
    rows = docs.select(text_key().alias("node"), "text")
    place = np.argsort(common)
    known = common[place].view(np.uint64)
    if len(known):
        place, known = place[np.argsort(known)], np.sort(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                fps, sizes, first, hot = [], [], [], []
                for t in part.column(1):
                    s = np.unique(shingle_hashes(t.as_py(), shingle))
                    n = len(s)
                    fps.append(majority(s))
                    sizes.append(n)
                    most = n - -(-OVERLAP[0] * n // OVERLAP[1]) + 1 if n else 0
                    often = np.zeros(0, np.uint64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        hit = known[at] == s
                        often, s = s[hit][np.argsort(place[at[hit]])], s[~hit]
                    first.append(s[:most])
                    hot.append(often[: max(0, most - len(s))])
                columns = [part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists(first), lists(hot)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "fp", "n", "first", "hot"])

    return rows.mapInArrow(each, "node long, fp long, n int, first array<long>, hot array<long>")


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes (nodes: node, n) an overlap of 0.8 allows."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_may_overlap()).select("a", "b")


def _may_overlap() -> Column:
    return F.least("na", "nb") * OVERLAP[1] >= F.greatest("na", "nb") * OVERLAP[0]


def overlapping(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets overlap by 0.8 or more, counted exactly. Only the texts that are named are
    read for it."""
    named = pairs.select(F.col("a").alias("h")).union(pairs.select("b"))
    _, some = split_by_keys(docs.select("text"), text_key(), named)
    sets = shingle_sets(some, shingle)
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    shared, both = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    held = shared * sum(OVERLAP) >= both * OVERLAP[0]
    return pairs.join(of("a"), "a").join(of("b"), "b").where(held).select("a", "b")


def overlap_groups(docs: DataFrame, shingle: int = STAGE_SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, component) of the texts that link at an overlap of 0.8 or more with another; node is text_key's.

    First each set meets those within max_bits and one other for each first shingle; then only sets of one first
    shingle that are still in different components meet, so that a large group of near copies never makes all its pairs.
    """
    rows = stage(sketches(docs, shingle, common_shingles(docs, shingle)), "sketches")
    nodes = stage(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n")), "nodes")
    lead = stage(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    at = lambda x: lead.select(F.col("fp").alias(x), F.col("lead").alias(f"n{x}"))
    near = near_pairs(lead.select("fp"), max_bits).join(at("a"), "a").join(at("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = nodes.join(lead, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))

    # Common shingles are dealt to several parts. The set with the most of them leads: of a text and its altered copies,
    # the text, which links to most of the others.
    salt = F.pmod(F.col("node"), F.lit(SALTS)).cast("int") + 1
    entries = rows.select("node", F.lit(0).alias("hot"), F.lit(0).alias("salt"), F.lit(0).alias("before"), F.posexplode("first").alias("place", "shingle"))
    entries = entries.union(rows.select("node", F.size("hot").alias("common"), salt.alias("salt"), F.size("first").alias("before"), F.posexplode("hot").alias("place", "shingle")))
    entries = entries.select("node", "shingle", (F.col("before") + F.col("place")).alias("place"), "hot", "salt")
    w = Window.partitionBy("shingle", "salt")
    rank = F.struct("hot", "node")
    met = entries.select("node", "shingle", "place", F.max(rank).over(w).alias("lead"), F.min(rank).over(w).alias("last"), "salt")
    first = stage(met.where("lead <> last or salt > 0").select("node", "shingle", "place", "lead").distinct(), "met")
    top = first.groupBy("shingle").agg(F.max("lead").alias("top"), F.min("lead").alias("low")).where("top <> low")
    stars = first.select(F.col("lead.node").alias("lead"), "node").union(first.select("shingle", "lead").distinct().join(top, "shingle").select("top.node", "lead.node"))
    stars = stars.where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    pairs = stage(near.union(same).union(stars).distinct().transform(alike, nodes), "candidates")
    links = stage(overlapping(pairs, docs, shingle), "overlaps")

    # Of such a pair's first shingles at least ``need`` are shared, or all later ones together would be too few; the first
    # of these has need - 1 others after it in both sets.
    comp = connected_components(links)
    part = first.select("node", "shingle", "place").join(nodes, "node").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    part = part.select("node", "shingle", "place", "n", "c", F.count(F.lit(1)).over(Window.partitionBy("node")).cast("int").alias("m"))
    group = Window.partitionBy("shingle")
    part = part.withColumn("least", F.min("c").over(group)).withColumn("most", F.max("c").over(group)).where("least <> most").drop("least", "most")
    a, b = (part.select("shingle", F.col("node").alias(x), *[F.col(c).alias(f"{c[0]}{x}") for c in ("n", "c", "m", "place")]) for x in "ab")
    later = lambda n: F.ceil(F.col(n) * F.lit(OVERLAP[0]) / F.lit(OVERLAP[1])) - 1
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(OVERLAP[0]) / F.lit(sum(OVERLAP))) - F.greatest(later("na"), later("nb"))
    early = (F.col("pa") <= F.col("na") - later("na") - need) & (F.col("pb") <= F.col("nb") - later("nb") - need)
    rest = a.join(b, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("ma", "mb") >= need) & early & _may_overlap())
    rest = stage(rest.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = stage(links.union(overlapping(rest, docs, shingle)), "all-overlaps")
    return connected_components(links)


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, of one document for each component of groups (doc_id, key, component).

    Rows are told by doc_id and text (key is its hash), so that null or repeated doc_ids of different texts don't touch
    each other. The smallest doc_id stays, then the smallest key; null ones only where a component has no other. Of
    repeated rows one stays. Rows in no group stay. Rows that surely go untouched, told by a bitmap of identifiers, stay
    where they are; the texts of the others are shuffled.
    """
    groups = stage(groups, "groups")
    best = groups.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("void"), "doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("rows"))
    met = groups.join(best.where("rows > 1"), "component")
    met = met.select("doc_id", "key", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))).alias("stays"))
    met = met.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows")).where("not stays or rows > 1")
    met = stage(met.select(F.col("doc_id").alias("__id"), F.col("key").alias("__met"), "stays"), "met-rows")
    apart, some = split_by_keys(docs, F.xxhash64("doc_id"), met.select(F.xxhash64("__id").alias("h")))
    some = some.withColumn("__key", text_key())
    at = some["doc_id"].eqNullSafe(met["__id"]) & (some["__key"] == met["__met"])
    kept = some.join(met, at, "left_anti")
    if not met.where("stays").isEmpty():
        kept = kept.unionByName(some.join(met.where("stays"), at, "left_semi").dropDuplicates(["doc_id", "__key"]))
    return apart.unionByName(kept.drop("__key"))


def drop_overlapping(docs: DataFrame, shingle: int = STAGE_SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document for each component of texts whose five-word shingles overlap by 0.8 or more; see keep_one.

    A text of fewer words than a shingle has one, its whole sequence; texts without words, null ones too, have none and
    form one group, as do equal texts. An empty table gives an empty result; any column but ``__key`` may occur.
    """
    groups = overlap_groups(docs.select("text"), shingle, max_bits).withColumnRenamed("node", "key")
    rows = docs.select("doc_id", text_key().alias("key"))
    return keep_one(docs, rows.join(groups, "key", "left").select("doc_id", "key", F.coalesce("component", "key").alias("component")))


def op9_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs)
