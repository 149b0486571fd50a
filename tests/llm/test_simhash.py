from __future__ import annotations

import random

import numpy as np
import xxhash

from lexmere.llm import simhash

from .conftest import ROWS


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(nodes):
    """nodes: [(id, fingerprint)]."""
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if bin(nodes[i][1] ^ nodes[j][1]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(nodes):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(nodes))]


def test_fingerprints():
    for _, text, *_ in ROWS:
        if not text or len(text) < 1000:
            assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(" \n") == 0


def test_against_brute_force(odd):
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_groups(odd).collect()), key=str)
    nodes = [(r[0], brute_fingerprint(r[1]) if len(r[1] or "") < 1000 else simhash.fingerprint(r[1])) for r in ROWS]
    assert got == sorted(((i, f, c) for (i, f), c in zip(nodes, components(nodes), strict=True)), key=str)


def test_pairs_are_whole(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = list(dict.fromkeys(seeds + [s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for s in seeds for _ in range(6)]))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    for most in (0, 1, 3, 4):
        got = {tuple(r) for r in simhash.near_pairs(rows, most).collect()}
        want = {(min(a, b), max(a, b)) for k, a in enumerate(signed) for b in signed[:k] if bin((a ^ b) & (1 << 64) - 1).count("1") <= most}
        assert got == want


def test_chain_and_stage(spark, odd, no_rows):
    from lexmere.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    nodes = [(r[0], simhash.fingerprint(r[1])) for r in ROWS]
    assert kept.count() == len(set(components(nodes)))
    assert simhash.near_groups(no_rows).count() == 0 and simhash.drop_near_copies(no_rows).count() == 0


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)} if words else set()


def overlap_components(texts):
    """The component of each text, linked where 0.8 or more of all five-word shingles are shared; by brute force."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(texts))]


def planted(rng, groups=25):
    """Texts with copies at overlaps from about 0.65 to 1, and a passage that all of them share."""
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(40)], []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(60, 250))] + passage
        texts.append(base)
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(len(base)), max(1, len(base) * rng.randint(1, 8) // 200)):
                copy[k] = word()
            texts.append(copy)
    return [" ".join(t) for t in texts] + ["a b", "A  b", "", " ", None]


def test_stage_drops_overlaps_of_eight_tenths(spark):
    import corpus_pipeline

    texts = planted(random.Random(5))
    want = {}
    for i, c in enumerate(overlap_components(texts)):
        want.setdefault(c, i)
    sets = [shingles(t) for t in texts]
    pairs = [len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a | b]
    assert sum(0.8 <= x < 0.95 for x in pairs) > 20 and sum(0.65 < x < 0.8 for x in pairs) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(want.values())


def test_null_and_shared_ids(spark):
    """Null ids on different texts, one id on two texts, repeated rows: each component keeps exactly one row."""
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(9000)}" for _ in range(80)) for _ in range(5))
    rows = [(None, a), (1, a), (None, b), (None, c), (None, c), (2, d), (2, e), (3, d), (3, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([(1, a), (None, b), (None, c), (2, d), (2, e)], key=str)
    assert sorted((tuple(r) for r in simhash.drop_near_copies(docs).collect()), key=str) == want
    assert sorted((tuple(r) for r in simhash.drop_overlapping(docs).collect()), key=str) == want


def test_short_texts_lose_no_pair(spark):
    """Pairs of nine and eight words share four of five shingles: each leaves exactly one document."""
    rng = random.Random(3)
    pairs = [[f"w{rng.randrange(10**7)}" for _ in range(9)] for _ in range(20_000)]
    rows = [(2 * k + x, " ".join(w[: 9 - x])) for k, w in enumerate(pairs) for x in (0, 1)]
    kept = simhash.drop_overlapping(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert kept.agg({"doc_id": "sum"}).first()[0] == sum(2 * k for k in range(20_000)) and kept.count() == 20_000


def test_clashing_columns(spark):
    from lexmere.llm import exact_dedup

    rows = [(1, "one two three four five six", 1, 2, 3, 4), (2, "one two three four five six", 1, 2, 3, 4), (3, "other", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __word int, __bits int, __h int, ___h int")
    for kept in (simhash.drop_overlapping(docs), exact_dedup.drop_copies(docs, keep="min")):
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
