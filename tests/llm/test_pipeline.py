from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, odd, no_rows, tmp_path):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.drop("kept", "rate")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for start in (docs, no_rows):
        rows = start
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, rows, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns
                n = out.count()
                assert n <= rows.count() or k == 3
                rows = out
        assert out.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.where(F.col("length") > 1024).count() == 0 and whole.count() > 0


def _planted():
    """300 documents: originals, exact copies in other case, near copies by one word, far copies by a word in six, short
    texts, texts without letters, null and empty ones. Words of their own, so that nothing else overlaps."""
    import random

    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 8)))
    originals = [[word() for _ in range(draw.randint(30, 60))] for _ in range(150)]
    texts = [" ".join(t) for t in originals]
    texts += [" ".join(t).upper() for t in originals[:40]]
    texts += [" ".join([*t[:-1], word()]) for t in originals[20:60]]
    texts += [" ".join(x if i % 6 else word() for i, x in enumerate(t)) for t in originals[60:90]]
    texts += ["abc def ghi", "abc def ghj", "12345 !!!", "", None] + ["lone words here today again maybe"] * 3
    draw.shuffle(texts)
    return [(i + 1, t) for i, t in enumerate(texts)]


def _sets(text):
    w = text.translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_composed_pipeline_against_brute_force(spark, tmp_path):
    """Rows kept by each stage, and the pieces of the last, from plain loops over the rows that the stage before kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lexmere.llm import mixing

    rows = _planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows[:60]], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    told = stages[0](spark, docs, str(tmp_path))
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert ids(told) == [i for i, _ in kept]

    best = {}
    for i, t in kept:
        best[t.lower()] = max(i, best.get(t.lower(), i))
    kept = [(i, t) for i, t in kept if best[t.lower()] == i]
    apart = stages[1](spark, told, str(tmp_path))
    assert ids(apart) == [i for i, _ in kept]

    sets, root = {i: _sets(t) for i, t in kept}, {i: i for i, _ in kept}
    for a in sorted(sets):
        for b in sets:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    kept = [(i, t) for i, t in kept if root[i] == i]
    assert len(kept) < len(root)
    one = stages[2](spark, apart, str(tmp_path))
    assert ids(one) == [i for i, _ in kept]

    mixed = stages[3](spark, one, str(tmp_path))
    want = sorted(r.doc_id for r in mixing.mix(one, labels).collect() for _ in range(r.copies))
    assert ids(mixed) == want and set(want) <= {i for i, _ in kept}

    packed = stages[4](spark, mixed, str(tmp_path)).select("doc_id", "length", "sequence_id", "offset").collect()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    text = dict(kept)
    assert sum(r.length for r in packed) == sum(len(tokenizer.encode(text[i], add_special_tokens=False).ids) + 1 for i in want)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
