"""Numbers and quantities in words over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.functions.numbers import HUNDREDS, ONES, TEEN_ONES, TENS, THOUSANDS, UNITS, number_words, parsed_number, quantities, quantity
from lexmere.plans.registry import Tables, query

_LISTS = f"{ONES[False]} AS om, {ONES[True]} AS of, {TEEN_ONES[False]} AS tm, {TEEN_ONES[True]} AS tf, {TENS} AS tens, {HUNDREDS} AS hs, {THOUSANDS} AS ts"
#: x (key, n, fem) as w (key, n, words): by digits, apart from the functions under test.
WORDS = f"""
p AS (SELECT *, n // 1000 AS t, n // 100 % 10 AS h, n % 100 AS r, n % 10 AS o, CASE WHEN fem THEN of ELSE om END AS ones, CASE WHEN fem THEN tf ELSE tm END AS teens FROM x, (SELECT {_LISTS})),
q AS (
  SELECT *, CASE WHEN r < 10 THEN ones[o + 1] WHEN r = 10 THEN CASE WHEN fem THEN 'עשר' ELSE 'עשרה' END WHEN r < 20 THEN teens[o + 1] || CASE WHEN fem THEN ' עשרה' ELSE ' עשר' END
              WHEN o = 0 THEN tens[r // 10 + 1] ELSE tens[r // 10 + 1] || ' ו' || ones[o + 1] END AS low FROM p),
b AS (SELECT *, CASE WHEN h = 0 THEN low WHEN r = 0 THEN hs[h + 1] WHEN r > 20 AND o > 0 THEN hs[h + 1] || ' ' || low ELSE hs[h + 1] || ' ו' || low END AS rest FROM q),
w AS (SELECT *, CASE WHEN t = 0 THEN rest WHEN rest = '' THEN ts[t + 1] WHEN contains(rest, ' ו') THEN ts[t + 1] || ' ' || rest ELSE ts[t + 1] || ' ו' || rest END AS words FROM b)
"""


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey * 7 + l_linenumber * 1009) % 9999 + 1 AS n, l_linenumber % 2 = 0 AS fem FROM lineitem), " + WORDS + "SELECT l_orderkey, l_linenumber, l_partkey, words, n AS back FROM w")
def numbers_in_words(t: Tables) -> DataFrame:
    """Numbers from 1 to 9,999 in words, and read back."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 1009) % 9999 + 1).alias("n"), (F.col("l_linenumber") % 2 == 0).alias("fem"))
    rows = rows.withColumn("words", number_words(F.col("n"), F.col("fem")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "words", parsed_number(F.col("words")).alias("back"))


_NAMES = list(UNITS)
_FORMS = f"{[f[0] for f in UNITS.values()]} AS one, {[f[1] for f in UNITS.values()]} AS two, {_NAMES} AS several"


@query(f"""WITH y AS (SELECT p_partkey, p_size AS n, p_partkey % 8 + 1 AS u, p_partkey % 8 IN (3, 4, 5) AS fem FROM part), x AS (SELECT * FROM y), {WORDS},
s AS (SELECT *, CASE WHEN n = 1 THEN one[u] WHEN n = 2 AND two[u] <> '' THEN two[u] WHEN n = 2 THEN CASE WHEN fem THEN 'שתי ' ELSE 'שני ' END || several[u] ELSE words || ' ' || several[u] END AS said FROM w, (SELECT {_FORMS}))
SELECT p_partkey, said AS text, n::BIGINT AS value, several[u] AS unit, false AS digits FROM s WHERE n > 1
UNION ALL SELECT p_partkey, (n * 1000)::VARCHAR || ' ' || several[u], n * 1000, several[u], true FROM s""")
def quantities_found(t: Tables) -> DataFrame:
    """Quantities in a sentence that has one in words, behind an and, and one in digits."""
    unit = F.get(F.array(*[F.lit(u) for u in _NAMES]), (F.col("p_partkey") % 8).cast("int"))
    text = F.concat(F.lit("תוך ו"), quantity(F.col("p_size"), unit), F.lit(" ולא יאוחר מ־"), (F.col("p_size") * 1000).cast("string"), F.lit(" "), unit, F.lit("."))
    dual = F.concat(F.lit("תוך "), quantity(F.col("p_size"), unit), F.lit(" או "), (F.col("p_size") * 1000).cast("string"), F.lit(" "), unit, F.lit("."))
    rows = t.part.select("p_partkey", F.explode(quantities(F.when(F.col("p_size") == 2, dual).otherwise(text))).alias("q"))
    return rows.select("p_partkey", "q.*")
