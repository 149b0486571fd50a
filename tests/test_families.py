from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexmere.functions.agreement import conjugate, gender, inflect, verb_form
from lexmere.operators.families import bank, expanded, planned, points, pool, scopes, screened

UNITS = "bill long, section long, number string, margin string, unit int, kind string, labels array<string>, text string, certain boolean"
RECORDS = "id string, level string, family string, template string, value string, status string, gender string, value_list string, approved_by string, approved_at string, approved_why string, approved_phrases array<string>"


def units(spark, *rows):
    return spark.createDataFrame(list(rows), UNITS)


def lead(text, section=1, bill=1, number="1", margin=None, certain=True):
    return (bill, section, number, margin, 1, "lead", [], text, certain)


def records(spark, *rows):
    return spark.createDataFrame([(i, "serious", f, t, v, "approved", None, None, None, None, None, None) for i, f, t, v in rows], RECORDS)


def texts(spark, rows, bank_rows=(), **options):
    found = points(units(spark, *rows), bank(records(spark, *bank_rows), 2026, options.pop("committee", None)), **options)
    return [r.text for r in pool(found).orderBy("bill", "section", "unit", "family", "anchor", "depth").collect()]


def test_forms(spark):
    cases = [("יתקן", ("", "לתקן", "m")), ("רשאית לתקן", ("רשאי", "לתקן", "f")), ("חייבים לתקן", ("חייב", "לתקן", "pl")), ("יתקנו", ("", "לתקן", "pl")), ("רשאי  לתקן", None), ("יאכל", None), ("", None), (None, None)]
    got = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(cases)], "k int, p string").select("k", verb_form(F.col("p")).alias("f")).orderBy("k").collect()
    assert [r.f and tuple(r.f) for r in got] == [w for _, w in cases]
    parts = [("", "לתקן", "fpl", "יתקנו"), ("רשאי", "לתקן", "fpl", "רשאיות לתקן"), ("מותר", "לתקן", "m", None), ("", "לאכול", "m", None), ("", "לתקן", "x", None)]
    got = spark.createDataFrame(parts, "m string, i string, n string, w string").select(conjugate(F.col("m"), F.col("i"), F.col("n")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)
    words = [("שר הפנים", "m"), ("הממשלה", "f"), ("ועדה ציבורית", "f"), ("היועץ המשפטי", "m"), ("גוף", None), ("", None), (None, None)]
    assert all(r.g == r.w for r in spark.createDataFrame(words, "p string, w string").select(gender(F.col("p")).alias("g"), "w").collect())
    turned = [("יתקן", "f", "תתקן"), ("תתקן", "f", "תתקן"), ("מוסמכת", "m", "מוסמך"), ("ממונה", "f", None)]
    assert all(r.g == r.w for r in spark.createDataFrame(turned, "p string, t string, w string").select(inflect(F.col("p"), F.col("t")).alias("g"), "w").collect())


def test_scopes_of_nested_units(spark):
    rows = [lead("רישה"), (1, 1, "1", None, 2, "subsection", ["(א)"], "", True), (1, 1, "1", None, 3, "paragraph", ["(א)", "(1)"], "אחת", True), (1, 1, "1", None, 4, "subparagraph", ["(א)", "(1)", "(ב)"], "שתיים", True), (1, 1, "1", None, 5, "subsection", ["(ב)"], None, True), lead("לבד", section=2)]
    got = [(r.section, r.unit, r.kind, r.address, r.leaf) for r in scopes(units(spark, *rows)).orderBy("section", "unit").collect()]
    assert got == [(1, 1, "lead", "ברישה, ", False), (1, 3, "paragraph", "בפסקה (א)(1), ", False), (1, 4, "subparagraph", "בפסקת משנה (א)(1)(ב), ", True), (2, 1, "section", "", True)]


def test_values(spark):
    only = {"families": ("value_change",)}
    assert texts(spark, [lead("ביום 31 בדצמבר 2020")], **only) == [f'במקום "2020" יבוא "{y}".' for y in (2021, 2022, 2019)] + [f'במקום "31" יבוא "{d}".' for d in (30, 29, 28)]
    assert texts(spark, [lead("עד 1,500 שקלים")], **only) == [f'במקום "1,500 שקלים" יבוא "{v} שקלים".' for v in ("3,000", "4,500", "6,000", "750")]
    assert texts(spark, [lead("תוך שלושים ימים")], **only)[0] == 'במקום "שלושים ימים" יבוא "שישים ימים".'
    assert 'במקום "ימים" יבוא "שנים".' in texts(spark, [lead("תוך שלושים ימים")], level="absurd", **only)
    assert texts(spark, [lead("לפי סעיף 5 ועוד 7 או 7 אנשים")], **only) == []  # a reference, and a number that stands twice
    assert texts(spark, [lead("עוד 7 אנשים", certain=False)], **only) == []
    assert texts(spark, [lead("עוד 998 אנשים")], **only) == ['במקום "998" יבוא "%s".' % v for v in ("999", "997", "1,000", "996")]


def test_deletions_leave_four_words(spark):
    only = {"families": ("deletion",)}
    assert texts(spark, [lead("אחת שתיים שלוש לפי העניין")], **only) == []
    assert texts(spark, [lead("אחת שתיים שלוש ארבע לפי העניין")], **only) == ['המילים "לפי העניין" – יימחקו.']
    two = [(1, 1, "1", None, k, "subsection", [label], "דבר", True) for k, label in ((1, "(א)"), (2, "(ב)"))]
    assert texts(spark, two, **only) == ["סעיף קטן (א) – יימחק.", "סעיף קטן (ב) – יימחק."] and texts(spark, two[:1], **only) == []


def test_actors_and_verbs(spark):
    swap = [("1", "actor_swap", "{value}", "הממשלה"), ("2", "actor_swap", "{value}", "הרשם"), ("3", "actor_swap", "{value}", "שר הפנים"), ("4", "actor_swap", "{value}", "גוף")]
    got = texts(spark, [lead("שר הפנים יתקן תקנות")], swap, families=("actor_swap",))
    assert got == ['במקום "שר הפנים יתקן" יבוא "הממשלה תתקן".', 'במקום "שר הפנים" יבוא "הרשם".']
    assert texts(spark, [lead("שר הפנים ממונה על כך")], swap, families=("actor_swap",)) == ['במקום "שר הפנים" יבוא "הרשם".']
    assert texts(spark, [lead("למילוי תפקידי המועצה")], swap, families=("actor_swap",)) == []
    duty = [("1", "duty", "{value}", "רשאי להביא=>יביא"), ("2", "duty", "{value}", "רשאי לתקן=>חייב לתקן")]
    for text, want in [("אינו רשאי לתקן", []), ("הם רשאיות לתקן", ['במקום "רשאיות לתקן" יבוא "חייבות לתקן".']), ("השר רשאי להביא בחשבון", []), ("השר רשאי להביא דבר", ['במקום "רשאי להביא" יבוא "יביא".'])]:
        assert texts(spark, [lead(text)], duty, families=("duty",)) == want


def test_marks(spark):
    approval = [("1", "approval", "באישור {value}", "{השר}"), ("2", "approval", "לאחר דיון ב{committee}", "")]
    both = [lead("הממשלה תתקן"), lead("שר הפנים יודיע", section=2)]
    only = {"families": ("approval",)}
    assert texts(spark, both, approval, committee="ועדת הכנסת", **only) == ['אחרי "הממשלה" יבוא "באישור שר הפנים".', 'אחרי "הממשלה" יבוא "לאחר דיון בוועדת הכנסת".', 'אחרי "שר הפנים" יבוא "לאחר דיון בוועדת הכנסת".']
    assert texts(spark, both[:1], approval, **only) == []  # no minister, no committee
    assert texts(spark, [lead("הממשלה תתקן בהסכמת שר הפנים ושר הבריאות")], approval, **only) == []
    closing = [("1", "after_last", "{value}", "תחילה|ביום 1 בינואר {השנה שאחרי הבאה}"), ("2", "after_last", "{value}", "תחולה|מיד")]
    got = texts(spark, [lead("א", margin=" תחולה "), lead("ב", section=2, number="2א")], closing, families=("after_last",))
    assert got == ['אחרי הסעיף יבוא: "תחילה 3. ביום 1 בינואר 2028"']
    assert texts(spark, [lead("א", number="א")], closing, families=("after_last",)) == []


def test_records(spark):
    rows = [("1", "{value}", "טוב", "approved", None, None), ("2", "{value}", "והליכוד", "approved", None, None), ("3", "{value}", "והליכוד", "approved", "x", ["ליכוד"]), ("4", "{value}", "רע", "approved", None, None), ("5", "{value}", "רע", "approved", "x", None), ("6", "{value}", "טוב", None, None, None), ("7", "{value}", "אין", "approved", None, None)]
    made = spark.createDataFrame([(i, "serious", "approval", t, v, s, None, None, a, a, a, p) for i, t, v, s, a, p in rows], RECORDS)
    key = F.substr(F.sha1(F.concat("template", F.lit("\x1f"), "value")), F.lit(1), F.lit(16))
    verdicts = made.where("id <> '7'").select("id", key.alias("key"), (F.col("value") != "רע").alias("allowed"))
    got = {r.id: r.reason for r in screened(made, verdicts.union(verdicts), {"parties": ["ליכוד"]}).collect()}
    assert got == {"1": None, "2": "redline: parties", "3": None, "4": "screened out", "5": None, "6": "status: ", "7": "not screened"}
    listed = made.limit(1).withColumn("value_list", F.lit("none"))
    assert expanded(listed, spark.createDataFrame([], "list string, item string, value string, gender string")).count() == 0


def test_nothing(spark):
    assert texts(spark, []) == [] and texts(spark, [lead(None), lead("", section=2)]) == []
    empty = points(units(spark), bank(records(spark), 2026))
    assert planned(empty, 5).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 40, 10_000])
def test_plans_equal_rounds(spark, n):
    """A plan that deals the lines of all points round by round, in plain loops."""
    draw = random.Random(n)
    made = [(bill, k, [f"{bill}/{k}/{j}" for j in range(draw.choice((1, 2, 2, 5, 9)))]) for bill in range(6) for k in range(draw.choice((1, 4, 13)))]
    want = set()
    for bill in {b for b, _, _ in made}:
        mine, depth, taken = [lines for b, _, lines in made if b == bill], 0, []
        while len(taken) < n and any(len(lines) > depth for lines in mine):
            taken += [lines[depth] for lines in mine if len(lines) > depth]
            depth += 1
        want |= set(taken[:n])
    schema = "bill long, section long, unit int, family string, op string, anchor string, place struct<section:long,tail:int,unit:long,family:int,pos:long>, budget boolean, lines array<struct<text:string,record:string>>"
    rows = spark.createDataFrame([(b, k, 1, "duty", "replace", str(k), (k, 0, 1, 3, 0), False, [(x, "") for x in lines]) for b, k, lines in made], schema)
    got = [r.text for r in planned(rows, n).collect()]
    assert len(got) == len(set(got)) and set(got) == want
