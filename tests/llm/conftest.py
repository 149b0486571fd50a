from __future__ import annotations

import pytest

LONG = "word " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and very long texts, copies in other case, repeated rows, ties, white space of all kinds.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "the QUICK brown fox jumps over the lazy dog.", "en", "a", 44),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (5, LONG, "en", "b", len(LONG)),
    (6, "Der schnelle braune Fuchs\u00dc springt \u00fcber den faulen Hund", "de", "a", 50),
    (6, "Der schnelle braune Fuchs\u00dc springt \u00fcber den faulen Hund", "de", "a", 50),
    (7, "12345 67890 !!! \u20ac", "en", "a", 17),
    (8, "one\ttwo\n\nthree\x0bfour  five ", "en", None, 25),
    (9, "one two three four five", "en", "a", 23),
    (None, "a row without identifier", "en", "a", 24),
    (10, "ONE", None, "a", 3),
    (11, "a\u00a0b <|endoftext|> c", "fr", "a", 20),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with an extra column whose name clashes with what operators add."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, DOCS).withColumn("kept", F.lit("x")).withColumn("rate", F.lit(1)).repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOCS)
