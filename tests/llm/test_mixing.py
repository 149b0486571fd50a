from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from lexmere.llm import mixing

from .conftest import ROWS

DOMAINS = ["clean", "junk", "toxic"]


def made(spark, n=900):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        kind = rng.choices(DOMAINS, [7, 2, 1])[0]
        own = {"clean": "law court text", "junk": "### $$$ ||| buy", "toxic": "idiot trash stupid"}[kind].split()
        docs.append((i, " ".join(rng.choices(own + ["the", "of", "and", "to"], k=rng.randint(1, 40)))))
        if rng.random() < 0.5:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    labels += [(10_000, 1, 1), (labels[0][0], None, None), (None, 1, 0), (7_000, None, None)]
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute(p, n, targets, rounds=2000):
    """Projected gradient steps in numpy."""
    m = np.linalg.inv((p * n[:, None]).T @ p)
    t = np.array(targets)
    wanted = t * (n @ p)[t.argmax()] / t.max()
    r = np.ones(len(n))
    for _ in range(rounds):
        r = np.maximum(0, r - p @ (m @ ((r * n) @ p - wanted)))
    return r, wanted


def test_rates_against_brute_force(spark):
    docs, labels, d, lab = made(spark)
    for targets in (mixing.TARGETS, {"clean": 0.5, "junk": 0.4, "toxic": 0.1}, {"clean": 0.2, "junk": 0.2, "toxic": 0.6}):
        got = {r.doc_id: r for r in mixing.mix(d, lab, targets).collect()}
        rows = [got[i] for i, _ in docs]
        p = np.array([[r.p_clean, r.p_junk, r.p_toxic] for r in rows])
        n = np.array([r.n_tokens for r in rows], float)
        assert n.tolist() == [len(t.split()) for _, t in docs] and np.allclose(p.sum(axis=1), 1)
        want, wanted = brute(p, n, [targets[k] for k in DOMAINS])
        rate = np.array([r.rate for r in rows])
        off, best = (np.abs((x * n) @ p - wanted).max() / wanted.sum() for x in (rate, want))
        assert (rate >= 0).all() and off <= best + 1e-3, (targets, off, best)
        shares = (rate * n) @ p / ((rate * n) @ p).sum()
        assert np.allclose(shares, [rows[0][f"share_{k}"] for k in DOMAINS])
        assert abs(sum(r.copies for r in rows) - rate.sum()) < 4 * math.sqrt(len(rows))
        assert all(math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1 for r in rows)


def shape(word):
    out = ""
    for c in word:
        sign = "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c
        if sign not in "aA0" or out[-1:] != sign:
            out += sign
    return "\x01" + out


def test_posteriors_by_hand(spark):
    docs, labels, d, lab = made(spark)
    start, weights = mixing.fit(d, mixing.label_domain(lab), DOMAINS)
    of = {i: "toxic" if t else "clean" if q else "junk" for i, q, t in labels if i is not None and q is not None}
    texts = {i: set(t.split()) | {shape(w) for w in t.split()} for i, t in docs}
    of = {i: x for i, x in of.items() if i in texts}
    sizes, total = Counter(of.values()), len(of)
    every = sorted(set().union(*texts.values()))
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", mixing.bucket(mixing.F.col("w")).alias("b")).collect()}
    assert len(set(bucket.values())) == len(bucket)
    want = [math.log((sizes[k] + 1) / (total + 3)) for k in DOMAINS]
    telling = 0
    for w, b in bucket.items():
        counts = [sum(w in texts[i] for i, x in of.items() if x == k) for k in DOMAINS]
        pooled = sum(counts) / total
        ratios = [(c + mixing.PRIOR) / (sizes[k] * pooled + mixing.PRIOR) for c, k in zip(counts, DOMAINS, strict=True)]
        if max(ratios) >= mixing.TELLING:
            rates = [min(1 - 1e-6, pooled * x) for x in ratios]
            telling += 1
            for j, r in enumerate(rates):
                want[j] += math.log(1 - r)
                assert weights[j][b] == pytest.approx(math.log(r / (1 - r)))
        else:
            assert all(weights[j][b] == 0 for j in range(3))
    assert telling and np.allclose(start, want)
    for row in mixing.posteriors(d.where("doc_id < 30"), (start, weights)).collect():
        logs = np.array([start[j] + sum(weights[j][bucket[w]] for w in texts[row.doc_id]) for j in range(3)])
        assert np.allclose(row["__p"], np.exp(logs) / np.exp(logs).sum(), rtol=1e-3)


def test_odd_rows(spark, odd, no_rows):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for lab in (labels, none):
        assert mixing.mix(odd, lab).count() == len(ROWS)
        taken = mixing.take_mixed(odd, lab)
        assert taken.columns == odd.columns and {r.doc_id for r in taken.collect()} <= {r[0] for r in ROWS}
    assert mixing.mix(no_rows, labels).count() == 0 and mixing.take_mixed(no_rows, labels).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_targets_and_recall_on_test_data(spark, size):
    """Targets are met within half a point; of the held-out labelled documents most junk and toxic ones are found."""
    import os

    folder = f"/root/testdata/{size}"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels).first()
    assert all(abs(got[f"share_{d}"] - t) < 0.005 for d, t in mixing.TARGETS.items())
    held = mixing.F.pmod(mixing.F.xxhash64("doc_id", mixing.F.lit(77)), mixing.F.lit(3)) == 0
    model = mixing.fit(docs, mixing.label_domain(labels.where(~held)), DOMAINS)
    true = mixing.label_domain(labels.where(held))
    rows = mixing.posteriors(docs.select("doc_id", "text").join(true, "doc_id"), model).collect()
    found = Counter((r.domain, DOMAINS[int(np.argmax(r["__p"]))]) for r in rows)
    recall = {d: found[d, d] / max(1, sum(n for (x, _), n in found.items() if x == d)) for d in DOMAINS}
    print(size, recall)
    assert recall["clean"] > 0.9 and recall["toxic"] > 0.5
