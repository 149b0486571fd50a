from __future__ import annotations

import random
import zlib

import numpy as np

from lexmere.llm import language_id

from .conftest import ROWS

WORDS = {
    "en": "the and of with house water people time there which would about after think",
    "de": "der und die nicht ein wasser haus menschen zeit welche wurde nach denken über",
    "fr": "le et les dans eau maison gens temps quelle serait après penser être",
}


def made(spark, n=240):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(5, 60))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), {r[0]: r for r in rows}


def test_held_out_accuracy(spark):
    docs, rows = made(spark)
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.97 * len(held)


def test_predictions_by_hand(spark):
    docs, rows = made(spark, 60)
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).collect()
    for r in got:
        x = np.log1p(np.bincount(language_id.trigrams(r.text), minlength=language_id.BUCKETS)) * model["idf"]
        cos = model["centroids"] @ (x / np.linalg.norm(x))
        assert abs(cos.max() - r.score) < 1e-5 and model["langs"][int(cos.argmax())] == r.lang_pred


def test_odd_rows(spark, odd, no_rows):
    got = {(r.doc_id, r.lang_pred == "und", r.rejected and r.lang_pred == "und") for r in language_id.identify(odd).collect()}
    assert {(3, True, True), (4, True, True), (7, True, True), (1, False, False)} <= got
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns
    assert {1, 2, 8, 9} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id in (3, 4, 7)").count() == 0
    assert language_id.identify(odd).count() == len(ROWS)
    assert language_id.identify(no_rows).count() == 0 and language_id.keep_identified(no_rows).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language_id.identify(unlabelled).collect()] == [("und", 0.0, True)]


def test_unlearned_languages_are_rejected(spark):
    """Training knows en and de: texts of other languages lie too far, texts of these two do not."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        import pytest

        pytest.skip("no test data")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.training_rows(docs.where("lang in ('en', 'de')")))
    share = {r.lang: r.share for r in language_id.predict(docs, model).groupBy("lang").agg(language_id.F.avg(language_id.F.col("rejected").cast("double")).alias("share")).collect()}
    assert share["fr"] > 0.8 and share["es"] > 0.8 and share["en"] < 0.01 and share["de"] < 0.01, share


def test_fit_by_brute_force(spark):
    """IDF, clusters and least cosines against plain counting and a k-means of its own."""
    import math

    docs, rows = made(spark, 60)
    model = language_id.fit(docs)
    grams = {i: set(language_id.trigrams(r[1]).tolist()) for i, r in rows.items()}
    for b in range(0, language_id.BUCKETS, 7):
        df = sum(b in g for g in grams.values())
        assert abs(model["idf"][b] - (math.log((1 + len(rows)) / (1 + df)) + 0.1 if df else 0)) < 1e-5
    least = []
    for lang in WORDS:
        x = language_id.vectors([r[1] for _, r in sorted(rows.items()) if r[2] == lang], model["idf"])
        own = [k for k, name in enumerate(model["langs"]) if name == lang]
        c = model["centroids"][own]
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(own)):  # each centroid is the direction of the mean of its own rows
            mean = x[near == j].mean(axis=0)
            assert np.dot(mean / np.linalg.norm(mean), c[j]) > 0.98
        least.append(language_id.HALF * np.quantile((x @ c.T).max(axis=1), language_id.FAR))
    assert abs(model["least"] - min(least)) < 1e-5
