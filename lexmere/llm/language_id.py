"""Language ID by nearest centroids.

Texts become normalised TF-IDF vectors of hashed byte trigrams. Document frequencies cover every training row; the
centroids of each language come from spherical k-means over a bounded sample of its training rows. A text takes the
language of the centroid with the largest cosine and is rejected where it lies much farther from it than training rows
lie from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType


BUCKETS = 1 << 13
CENTROIDS = 4
#: Training rows of each language that the clustering sees (all rows count for document frequencies).
SAMPLE = 1500
#: The share of a language's training rows that may lie far from its centroids. Texts are rejected where their cosine is
#: below half of what the others reach in the language where that is least; so a language of few training rows isn't held
#: to their distances alone.
FAR, HALF = 0.01, 0.5
LETTER = regex.compile(r"\p{L}")
#: Bytes as they count: letters and the bytes of longer characters as they are, all others a space.
FOLD = np.array([b if b > 0x7F or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text, lower-cased; runs of ASCII characters that aren't letters become one space."""
    a = FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    space = a == 0x20
    a = a[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    key = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of hashed trigram counts for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for k, t in enumerate(texts):
        if t:
            out[k] = np.bincount(trigrams(t), minlength=BUCKETS)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Unit rows log(1 + count) * idf; texts without trigrams have a zero row."""
    x = np.log1p(counts(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Number of training texts, and for each bucket the number of them that hold it. Each task adds its rows up first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column("text"):
                n += 1
                df[np.unique(trigrams(t.as_py() or ""))] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["bucket", "n"])

    rows = train.select("text").mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n, df = 0, np.zeros(BUCKETS, np.int64)
    for bucket, count in rows:  # BUCKETS + 1 rows at most
        if bucket < 0:
            n = count
        else:
            df[bucket] = count
    return n, df


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of spherical k-means; starts from rows far from each other."""
    first = [int(np.argmax(x @ x.mean(axis=0)))]
    best = x @ x[first[0]]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[first[-1]])
    c = x[first]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> dict:
    """train: (doc_id, text, lang) with non-null texts and languages. Returns idf, each
    centroid's language, the centroids, and the least cosine.

    The sample is every training row whose hash falls below the share that makes about ``sample`` rows of its
    language; each language is clustered in a task of its own.
    """
    n, df = document_frequencies(train)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.1, 0).astype(np.float32)
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    some = train.join(F.broadcast(sizes), "lang").where(u < share).select("lang", "text", "doc_id")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = vectors(list(pdf["text"]), idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        c = cluster(x, k)
        least = float(HALF * np.quantile((x @ c.T).max(axis=1), FAR))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [r.astype(np.float32).tobytes() for r in c], "least": least})

    rows = some.groupBy("lang").applyInPandas(one, "lang string, centroid binary, least double").collect()  # k rows a language
    rows = sorted(map(tuple, rows))
    matrix = np.stack([np.frombuffer(c, np.float32) for _, c, _ in rows]) if rows else np.zeros((0, BUCKETS), np.float32)
    return {"idf": idf, "langs": [lang for lang, _, _ in rows], "centroids": matrix, "least": min((x for _, _, x in rows), default=0.0)}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected as the last columns of docs' rows.

    lang_pred is a learned language, or ``und`` where the text is null, has no letter or nothing was learned; score is
    the largest cosine. ``und`` and texts whose cosine is below the least one are rejected.
    """
    langs, centroids, idf, least = model["langs"], model["centroids"], model["idf"], model["least"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            lang, score, reject = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            known = [k for k, t in enumerate(texts) if t and langs and LETTER.search(t)]
            for i in range(0, len(known), 128):
                part = known[i : i + 128]
                cos = vectors([texts[k] for k in part], idf) @ centroids.T
                best = cos.argmax(axis=1)
                for k, j, c in zip(part, best, cos.max(axis=1), strict=True):
                    lang[k], score[k], reject[k] = langs[j], min(1.0, max(0.0, float(c))), c < least
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score), pa.array(reject)], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return docs.mapInArrow(each, schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs (doc_id, text, lang).

    Learns from rows with a text and a language whose crc32(doc_id) mod 5 is not 0; a null doc_id counts as training
    row. Repeated rows give repeated rows, an empty table an empty result.
    """
    model = fit(training_rows(docs))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang), with all their columns, that are not rejected.

    Null and empty texts and those without a letter go, as does everything where no row has a text and a language.
    Repeated rows stay or go together; an empty table gives an empty result; columns may have any names.
    """
    model = fit(training_rows(docs))
    names = docs.columns
    renamed = docs.toDF(*[f"c{k}" for k in range(len(names))])
    kept = predict(renamed, model, text_col=f"c{names.index('text')}").where("not rejected").drop("lang_pred", "score", "rejected")
    return kept.toDF(*names)


def op10_language_id(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
