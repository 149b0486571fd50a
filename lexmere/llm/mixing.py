"""Mixing documents to target weights by soft membership.

Domains are the classes of a labelled table. A naive Bayes classifier over hashed words, fitted on a bounded sample of
labelled documents, gives every document its posterior over the domains. Each document then gets a nonnegative rate
such that the expected tokens of each domain, sum(rate * tokens * posterior), match the targets: least squares,
solved by projected gradient steps. A step needs one sum for each domain over all documents; documents keep their own
rate, and the driver sees vectors of one number for each domain.

Everything here is DataFrame functions; the driver only does arithmetic on numbers of bounded count.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.llm.common import stage

#: Wanted shares of tokens.
TARGETS = {"clean": 0.95, "junk": 0.03, "toxic": 0.02}
BUCKETS = 1 << 14
#: Labelled rows (about) that the classifier is fitted on.
SAMPLE = 20_000
#: Documents that a feature counts as met in, and expected in, besides those counted: its likelihood ratios are
#: so drawn towards 1, the more the fewer documents hold it.
PRIOR = 1.0
#: A feature counts if its likelihood ratio in some domain is so large.
TELLING = 3.0
#: Steps at most, what counts as met, and steps after which rates are written down.
ROUNDS, TOLERANCE, WRITTEN = 60, 1e-4, 8


def label_domain(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else clean or junk by quality. Repeated labels of a document are joined: toxic if any
    says so, clean if any does; labels without a value count as unlabelled."""
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "junk")
    return one.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def features(text: Column) -> Column:
    """Buckets of a text's distinct words and word shapes (runs of small letters, capitals and digits as one sign each)."""
    shape = F.coalesce(text, F.lit(""))
    for run, sign in ((r"[a-zà-öø-ÿ]+", "a"), (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[0-9]+", "0")):
        shape = F.regexp_replace(shape, run, sign)
    shapes = F.transform(F.array_distinct(words(shape)), lambda w: F.concat(F.lit("\x01"), w))
    return F.transform(F.concat(F.array_distinct(words(text)), shapes), bucket)


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[list[float], list[list[float]]]:
    """Bernoulli naive Bayes: for each domain the log of its prior and of having no feature, and each bucket's log odds.

    Only telling features count, those well over-represented in some domain: common words would otherwise add up over
    a long text to more than they know. The sample is every labelled row whose hash falls below the share that makes
    about ``sample`` rows.
    """
    n = labels.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    some = labels.where(u < min(1.0, sample / max(n, 1)))
    train = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", F.array_distinct(features(F.col("text"))).alias("b"))
    train = stage(train, "training")
    sizes = {r[0]: r[1] for r in train.groupBy("domain").count().collect()}
    rows = train.select("domain", F.explode("b").alias("b")).groupBy("domain", "b").count().collect()
    held = {d: [0.0] * BUCKETS for d in domains}
    for domain, b, count in rows:  # a row for each domain and bucket at most
        if domain in held:
            held[domain][b] = count
    total = sum(sizes.get(d, 0) for d in domains)
    start = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    weights = [[0.0] * BUCKETS for _ in domains]
    for b in range(BUCKETS):
        pooled = sum(held[d][b] for d in domains) / max(total, 1)
        ratios = [(held[d][b] + PRIOR) / (sizes.get(d, 0) * pooled + PRIOR) for d in domains]
        if max(ratios) >= TELLING:
            for k, ratio in enumerate(ratios):
                r = min(1 - 1e-6, pooled * ratio)
                start[k] += math.log(1 - r)
                weights[k][b] = math.log(r / (1 - r))
    return start, weights


def _summed(buckets: Column, start: float, weights: Column) -> Column:
    return F.aggregate(buckets, F.lit(start), lambda s, b: s + F.get(weights, b))


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], text_col: str = "text") -> DataFrame:
    """Adds __tokens (words) and __p (posterior over the domains) to each row."""
    priors, weights = model
    # The weights travel as one constant each: a literal that the optimizer folds to an array.
    arrays = [F.split(F.lit(",".join(f"{w:.5g}" for w in ws)), ",").cast("array<double>") for ws in weights]
    rows = docs.withColumn("__w", words(F.col(text_col))).withColumn("__tokens", F.size("__w").cast("double"))
    rows = rows.withColumn("__b", F.array_distinct(features(F.col(text_col)))).drop("__w")
    logs = [_summed(F.col("__b"), prior, a) for prior, a in zip(priors, arrays, strict=True)]
    rows = rows.withColumn("__l", F.array(*logs)).drop("__b")
    rows = rows.withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l")))).drop("__l")
    total = F.aggregate("__e", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("__p", F.transform("__e", lambda x: x / total)).drop("__e")


def inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a small matrix, with a ridge that keeps domains without tokens solvable."""
    n = len(m)
    ridge = 1e-9 * max(max(m[i][i] for i in range(n)), 1.0)
    a = [[m[i][j] + ridge * (i == j) for j in range(n)] + [float(i == j) for j in range(n)] for i in range(n)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[n:] for row in a]


def rates(rows: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float], float]:
    """rows (__tokens, __p) with their rate as __rate, the achieved share of each domain, and what the optimum lacks.

    Targets are shares of as many tokens as let the domain with the largest share be taken once on average; scarcer
    domains may have rates above 1. Rates start from 1. Steps are scaled by the inverse of the domains' matrix
    sum(tokens * p * p'), in the metric in which a document weighs by its tokens: without the bound at 0, one step
    meets the targets. A step uses the matrix over the rows that are still above 0; where that doesn't bring the sums
    nearer, it uses the whole one, for which each step does.

    Steps end when the targets are met or the gradient certifies the optimum: it is 0 where a rate is above 0 and not
    below 0 elsewhere. The last value returned is the gradient's violation per token, 0 where targets are met; a
    warning tells of one that ``rounds`` steps have left above ten times the tolerance.
    """
    k = len(targets)
    n, p = F.col("__tokens"), [F.col("__p")[i] for i in range(k)]

    def measure(rate: Column) -> tuple[list[float], list[list[float]]]:
        """Expected tokens of each domain, and the domains' matrix over the rows whose rate is above 0."""
        live = n * (rate > 0).cast("double")
        sums = rows.agg(*[F.sum(n * p[i] * rate) for i in range(k)], *[F.sum(live * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
        sums = [x or 0.0 for x in sums]
        return sums[:k], [sums[k + i * k : 2 * k + i * k] for i in range(k)]

    rows = rows.withColumn("__rate", F.lit(1.0))
    rate = F.col("__rate")
    supply, matrix = have, live = measure(rate)
    metric = inverse(matrix)
    main = max(range(k), key=lambda i: targets[i])
    wanted = [w * supply[main] / targets[main] for w in targets]
    total = max(sum(supply), 1.0)

    def off_by(have: list[float]) -> float:
        off = [h - w for h, w in zip(have, wanted, strict=True)]
        return math.sqrt(max(0.0, sum(off[i] * metric[i][j] * off[j] for i in range(k) for j in range(k))) / total)

    def along(m: list[list[float]], have: list[float]) -> Column:
        g = [sum(m[i][j] * (have[j] - wanted[j]) for j in range(k)) for i in range(k)]
        return sum((p[i] * g[i] for i in range(k)), F.lit(0.0))

    def violation(rate: Column, have: list[float]) -> float:
        slope = along(metric, have)
        return (rows.agg(F.sum(n * F.when(rate > 0, F.least(rate, F.lit(1.0)) * F.abs(slope)).otherwise(F.greatest(-slope, F.lit(0.0))))).first()[0] or 0.0) / total

    lacking = 0.0
    for step in range(1, rounds + 1):
        size = off_by(have)
        if size <= tolerance:
            lacking = 0.0
            break
        for m in (inverse(live), metric):  # the rows that can still give way alone; if that overshoots, all
            then = F.greatest(F.lit(0.0), rate - along(m, have))
            reached, left = measure(then)
            if off_by(reached) < size:
                rate, have, live = then, reached, left
                break
        else:
            lacking = violation(rate, have)
            break
        if step % WRITTEN == 0 or size - off_by(have) <= tolerance * 0.01:
            lacking = violation(rate, have)
            if lacking <= tolerance:
                break
            rows = stage(rows.withColumn("__rate", rate), "rates")  # steps don't pile up in one expression
            rate = F.col("__rate")
    if lacking > 10 * tolerance:
        warnings.warn(f"rates are off their optimum: shares {[h / max(sum(have), 1.0) for h in have]}, violation {lacking}", stacklevel=2)
    return rows.withColumn("__rate", rate), [h / max(sum(have), 1.0) for h in have], lacking


def copies(rate: Column, id_col: str = "doc_id") -> Column:
    """How often a document of this rate is taken: the rate on average, by a hash of its identifier."""
    return F.floor(rate + F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(1 << 30)) / float(1 << 30)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, posterior of each domain (p_<domain>), rate and copies of every row of docs (doc_id, text), and
    the achieved share of each domain (share_<domain>), the same on every row.

    A null text is empty; empty texts have the priors as posterior and weigh nothing. Repeated rows are documents of
    their own with equal rates. Without labels all documents have the same posterior and rate. An empty table gives an
    empty result. Other columns are ignored.
    """
    domains = list(targets)
    model = fit(docs, label_domain(labels), domains)
    rows = stage(posteriors(docs.select("doc_id", "text"), model).drop("text"), "posteriors")
    rows, shares, _ = rates(rows, [targets[d] for d in domains])
    return rows.select(
        "doc_id",
        F.col("__tokens").cast("long").alias("n_tokens"),
        *[F.col("__p")[i].alias(f"p_{d}") for i, d in enumerate(domains)],
        F.col("__rate").alias("rate"),
        copies(F.col("__rate")).alias("copies"),
        *[F.lit(x).alias(f"share_{d}") for d, x in zip(domains, shares, strict=True)],
    )


def take_mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs (doc_id, text), with all their columns, each as often as its rate says.

    Null and empty texts weigh nothing and are taken as often as the priors say; rows with one identifier, null ones too,
    draw alike. An empty table gives an empty result; columns may have any names.
    """
    domains = list(targets)
    model = fit(docs, label_domain(labels), domains)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = stage(posteriors(plain, model, text_col), "mixed")
    rows, _, _ = rates(rows, [targets[d] for d in domains])
    taken = rows.withColumn("__n", copies(F.col("__rate"), id_col)).where("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), "__n")))
    return taken.select(*plain.columns).toDF(*docs.columns)


def op2_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
