from __future__ import annotations

from pyspark.sql import functions as F

from lexmere.functions.numbers import number_words, parsed_number, quantities, quantity


def test_round_trip(spark):
    rows = spark.range(1, 100_000).select("id", F.explode(F.array(F.lit(True), F.lit(False))).alias("f"))
    rows = rows.select("id", "f", number_words(F.col("id"), F.col("f")).alias("w")).cache()
    assert rows.where(parsed_number(F.col("w")) != F.col("id")).count() == 0 and rows.where(parsed_number(F.col("w")).isNull()).count() == 0
    assert rows.select("f", "w").distinct().count() == 2 * 99_999


def test_words(spark):
    cases = [(3, False, "שלושה"), (12, True, "שתים עשרה"), (21, True, "עשרים ואחת"), (120, False, "מאה ועשרים"), (365, False, "שלוש מאות שישים וחמישה"), (1100, False, "אלף ומאה"), (2007, True, "אלפיים ושבע"), (11_000, False, "אחד עשר אלף"), (0, False, None), (100_000, False, None)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, n long, f boolean, w string")
    assert [r.w for r in rows.select("k", number_words(F.col("n"), F.col("f")).alias("w")).orderBy("k").collect()] == [c[2] for c in cases]


def test_reading(spark):
    cases = [("שלושה עשר", 13), ("מאה ועשרים", 120), ("אלף", 1000), ("שלושת אלפים ומאה", 3100), ("יום", None), ("", None), (None, None), ("עשרת אלפים", 10_000)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, w string, n long")
    assert [r.n for r in rows.select("k", parsed_number(F.col("w")).alias("n")).orderBy("k").collect()] == [c[1] for c in cases]


def test_quantities(spark):
    units = [(1, "ימים", "יום"), (2, "ימים", "יומיים"), (2, "דקות", "שתי דקות"), (2, "שקלים", "שני שקלים"), (21, "שנים", "עשרים ואחת שנים"), (3, "פילים", None)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(units)], "k int, n long, u string, w string")
    assert [r.w for r in rows.select("k", quantity(F.col("n"), F.col("u")).alias("w")).orderBy("k").collect()] == [c[2] for c in units]
    text = "תוך שלושים ימים וחמישה אחוזים, 1,500 שקלים או שנתיים; 3.5 שקלים, בימים"
    found = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(quantities(F.col("t")).alias("q")).collect()
    assert [tuple(x) for x in found[0].q] == [("שלושים ימים", 30, "ימים", False), ("חמישה אחוזים", 5, "אחוזים", False), ("1,500 שקלים", 1500, "שקלים", True), ("שנתיים", 2, "שנים", False)]
    assert found[1].q == []
