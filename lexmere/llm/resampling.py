"""Importance resampling towards a target: hashed word n-grams, one gain a bucket, Gumbel top-k.

All of it is Spark SQL. Features (runs of one to three words) are exploded and hashed to buckets where a text is read, and
counted by bucket before anything moves. A table with a row for each bucket, whose size is fixed, goes to all tasks, and
a document's gains are summed in the task that holds it. The draw is a sort by score over ranges, each range's rows
numbered from the number of rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.llm.common import ascii_lower, stage, table

BUCKETS = 10_000
#: Documents with fewer words are never drawn; of the others, so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: Bits of a row's place in the numbers that monotonically_increasing_id gives; the partition's number is above them.
WIDE = 33


def words(text: Column) -> Column:
    """The words of a text: lower-cased runs of digits, letters and whatever isn't ASCII; none of a null text."""
    return F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def bucket_of(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(F.encode(feature, "UTF-8")), F.lit(buckets)).cast("int")


def features(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The columns of rows but the text, and bucket: a row for each feature of the text, and rows with a null bucket where
    runs would go beyond its end; a text without words has these alone."""
    others = [F.col(c) for c in rows.columns if c != text_col]
    each = rows.select(*others, words(F.col(text_col)).alias("w"))
    n = F.size("w")
    runs = F.arrays_zip("w", F.slice("w", 2, F.greatest(n - 1, F.lit(0))), F.slice("w", 3, F.greatest(n - 2, F.lit(0))))
    at = each.select(*others, F.explode_outer(runs).alias("r"))  # each word with the two after it, null where the text ends
    a, b, c = F.col("r")["w"], F.col("r")["1"], F.col("r")["2"]
    grams = F.explode(F.array(a, F.concat(a, F.lit(" "), b), F.concat(a, F.lit(" "), b, F.lit(" "), c)))
    return at.select(*others, grams.alias("g")).select(*others, bucket_of(F.col("g"), buckets).alias("bucket"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of each bucket that docs hold: how much more of the target than of docs lies there."""
    source = features(docs.select(text_col), text_col, buckets).select("bucket", F.lit(1).alias("s"), F.lit(0).alias("t"))
    wanted = features(target.select(text_col), text_col, buckets).select("bucket", F.lit(0).alias("s"), F.lit(1).alias("t"))
    counts = source.unionByName(wanted).where("bucket is not null").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    counts = stage(counts, "buckets")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s_all, t_all = (F.lit(float(x + buckets)) for x in total)
    ratio = ((F.col("t") + 1).cast("double") * s_all) / ((F.col("s") + 1).cast("double") * t_all)
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of docs. gains has one row for each of ``buckets`` buckets at most."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    each = features(rows, "text", buckets).join(F.broadcast(gains), "bucket", "left")
    sums = each.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    # n words give n runs of one, n - 1 of two and n - 2 of three
    n = F.when(F.col("n_features") < 3, (F.col("n_features") + 1) / 2).otherwise((F.col("n_features") + 3) / 3)
    return sums.select("doc_id", n.cast("long").alias("n_words"), "n_features", "weight")


def noise(id_col: Column, seed: int = 42) -> Column:
    """floor(1000 x) of a Gumbel variate x that the identifier and the seed fix; an absent identifier counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, eligible: Column, order: list[Column], share: Column) -> DataFrame:
    """rows with rank: 1, 2, 3 and so on over the eligible rows in the order given, null beyond share (of their number)
    and on the others.

    Rows are sorted over ranges and written once, with their place within the range; then one row a range says how many
    eligible rows lie before it. No task takes more than its range.
    """
    placed = rows.withColumn("__out", F.when(eligible, 0).otherwise(1)).repartitionByRange(F.col("__out"), *order).sortWithinPartitions(F.col("__out"), *order)
    placed = stage(placed.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    ranges = placed.groupBy(F.shiftright("__at", WIDE).alias("__range")).agg(F.count_if(F.col("__out") == 0).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("__range", before.alias("__before"))  # a row for each range
    drawn = share(ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << WIDE) - 1)) + 1
    met = placed.join(F.broadcast(starts), F.shiftright("__at", WIDE) == F.col("__range"))
    return met.withColumn("rank", F.when((F.col("__out") == 0) & (place <= drawn), place)).drop("__out", "__at", "__range", "__before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank. target needs a column text_col.

    Null and empty texts have no features, weight 0 and are never drawn; nor are texts of fewer than least_words words.
    Long texts count whole. Ties in score go to the smaller identifier, an absent one last; repeated rows have equal scores
    and a rank each. Empty tables give empty results; an empty target leaves the gains to the documents' own counts.
    Other columns of either table, whatever their names, are left alone.
    """
    gains = bucket_gains(docs, target, text_col, buckets)
    scored = weights(docs, gains, id_col, text_col, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stage(scored, "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    out = ranked(scored, F.col("n_words") >= least_words, order, lambda n: percent * n // 100)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A feature's crc32 is folded over the halves of its bytes, by a table of sixteen entries.
OP13_SQL = r"""
WITH nib AS (SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
f AS (
  SELECT r, unnest(w) AS g FROM d UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d),
u AS (
  SELECT unnest(w) AS g FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b
  UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM b),
k AS (SELECT g, count(*) AS s FROM f GROUP BY 1),
q AS (SELECT g, count(*) AS t FROM u GROUP BY 1),
h AS (
  SELECT g, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(2 * strlen(g)), lambda i: ('0x' || x[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END])::BIGINT)),
           lambda c, y: xor(c >> 4, nib[(xor(c, y) & 15) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT g, coalesce(s, 0) AS s, coalesce(q.t, 0) AS t, hex(encode(g)) AS x, nib.t AS nib FROM k FULL JOIN q USING (g) CROSS JOIN nib)),
m AS (SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (any_value(s_all) + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (any_value(t_all) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM h, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM h) GROUP BY 1),
w AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN h USING (g) JOIN m USING (bucket) GROUP BY 1),
z AS (
  SELECT d.r, doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w ON w.r = d.r),
o AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM o
"""
