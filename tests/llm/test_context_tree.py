from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmere.llm import context_tree as ct

from .conftest import ROWS


class Node:
    def __init__(self):
        self.n, self.children = [0, 0], {}


class Brute:
    """Context trees node by node, after the definition."""

    def __init__(self, docs):
        self.roots = {}
        for d in docs:
            for q, ctx, bit in self.steps(d):
                node = self.roots.setdefault(q, Node())
                node.n[bit] += 1
                for c in ctx:
                    node = node.children.setdefault(c, Node())
                    node.n[bit] += 1
        for r in self.roots.values():
            self.weigh(r)

    @staticmethod
    def steps(d):
        data = b"\n" * ct.DEPTH + d + b"\n"
        for i in range(ct.DEPTH, len(data)):
            q = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield q, [data[i - j] for j in range(1, ct.DEPTH + 1)], bit
                q = q * 2 + bit

    def weigh(self, node):
        a, b = node.n
        node.own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if not node.children:
            node.log, node.share = node.own, 1.0
            return
        below = 0.0
        for c in node.children.values():
            self.weigh(c)
            below += c.log
        node.log = np.logaddexp(node.own, below) - math.log(2)
        node.share = 0.5 * (1 + math.tanh((node.own - below) / 2))

    def predict(self, node, ctx):
        kt = (node.n[1] + 0.5) / (sum(node.n) + 1)
        child = node.children.get(ctx[0]) if ctx else None
        return kt if child is None else node.share * kt + (1 - node.share) * self.predict(child, ctx[1:])

    def score(self, d):
        out = 0.0
        for q, ctx, bit in self.steps(d):
            p = self.predict(self.roots[q], ctx) if q in self.roots else 0.5
            out += math.log10(p if bit else 1 - p)
        return out


def test_against_brute_force(spark, odd, monkeypatch):
    rows = [r for r in ROWS if len(r[1] or "") < 1000] + [(k, "the cat sat on the mat " * (k % 4) + f"no {k}", "en", "a", 0) for k in range(20, 60)]
    docs = spark.createDataFrame(rows, odd.schema.simpleString()[7:-1].replace(":", " ").replace(",kept string,rate int", "")).repartition(3)
    monkeypatch.setattr(ct, "BLOCK", 200)
    monkeypatch.setattr(ct, "CHUNK", 500)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = [ct.canonical(r[1]) for r in rows if not held(r[0])]
    brute = Brute(train)
    counts = Counter(w for d in train for w in [*(d.split(b" ") if d else []), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        d = ct.canonical(r[1])
        words = [*(d.split(b" ") if d else []), None]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.append((r[0], held(r[0]), len(words), sum(w in counts for w in words), n, base, brute.score(d)))
    got = [tuple(r)[:7] for r in ct.score_documents(docs).collect()]
    assert any(r[1] for r in want) and len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_probabilities_sum_to_one():
    keys, n = np.unique(ct.strings([b"abracadabra", b"abba", b"\xff\x00"])[0], return_counts=True)
    keys = np.union1d(keys, (keys[5] & ~np.uint64(0xFF)) | np.arange(256, dtype=np.uint64))
    counts = np.zeros(len(keys))
    counts[np.searchsorted(keys, np.unique(ct.strings([b"abracadabra", b"abba", b"\xff\x00"])[0]))] = n
    x = ct.levels(keys, counts)[0]
    node, at = np.unique(x.parents(None), return_inverse=True)
    top = ct.Top(list(zip(node.tolist(), *(np.bincount(at, weights=w).tolist() for w in (x.a, x.b, x.log)), strict=True)))
    p = ct.log10_probabilities(keys, counts, (top.mixed, top.rest, top.last))
    whole = keys >> np.uint64(8) == (keys[5] >> np.uint64(8))
    assert whole.sum() >= 256 and (10 ** p[whole]).sum() == pytest.approx(1)


def test_long_and_empty(spark, odd, no_rows):
    got = {r.doc_id: r for r in ct.score_documents(odd).collect()}
    assert got[5].n_tokens == 30_001 and got[5].bits_per_byte < 0.1 and got[3].n_tokens == got[4].n_tokens == 1
    assert ct.score_documents(no_rows).count() == 0
    only_held = spark.createDataFrame([(i, "text here") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    r = ct.score_documents(only_held).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-80 * math.log10(2))


def test_numbers_round_trip():
    for kind in ("<u4", "<u8", "<f8"):
        x = np.arange(1000).astype(kind)
        assert (ct.numbers(ct.squeeze(x), kind) == x).all()
