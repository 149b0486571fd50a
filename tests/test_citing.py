"""Cited sections by hand, and labels of every gap against a search on sets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexmere.functions.numbering import SUFFIXES
from lexmere.operators.citing import amended_law, cited_numbers, cited_sections_of, insertion_labels

LINE = "bill_id long, at long, depth long, number string, heading string, text string"


def test_names_of_amended_laws(spark):
    cases = {
        'בחוק התכנון והבנייה, התשכ"ה–1965, בסעיף 110 –': 'חוק התכנון והבנייה, התשכ"ה–1965',
        "בפקודת התעבורה –": "פקודת התעבורה",
        'בחוק הגבלת שימוש במקום לשם מניעה, התשס"ה–2005, בסעיף 3א(ב), יימחקו': 'חוק הגבלת שימוש במקום לשם מניעה, התשס"ה–2005',
        'בחוק הצבת מכשירים, התשס"ח–2008 (להלן – החוק העיקרי), בסעיף 1': 'חוק הצבת מכשירים, התשס"ח–2008',
        "בחוק־יסוד: הכנסת, אחרי סעיף 4 יבוא:": "חוק־יסוד: הכנסת",
        "תחילתו של חוק זה": "", "בחוקים": "", "": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert rows.where(amended_law(F.col("text")) != F.col("want")).collect() == []


def test_numbers_of_a_line(spark):
    cases = [
        ("בסעיף 110 –", None, ["110"]), ("אחרי סעיף 9א1 יבוא:", "הוספת סעיף 9א2", ["9א1"]),
        ("בסעיפים 2, 3א ו-4 לחוק העיקרי,", None, ["2", "3א", "4"]), ("כהגדרתו בסעיף 158טו1 לחוק התכנון;", None, []),
        ("יבוא, בסעיף 5(ב) לחוק התכנון", None, []), ("יבוא, בסעיף 5(ב) לחוק העיקרי", None, ["5"]),
        ("סעיף 39 – בטל.", "ביטול סעיף 39", ["39", "39"]), ("רשימה הזכאים להצביע כאמור בסעיף 95ד, ורשאי", None, []),
        ("", "תיקון סעיפים 7 ו-8", ["7", "8"]), (None, None, []), ("בסעיף קטן (א)", None, []),
    ]
    rows = spark.createDataFrame([(t, h, w) for t, h, w in cases], "text string, heading string, want array<string>")
    got = rows.select("text", cited_numbers(F.col("text"), F.col("heading")).alias("got"), "want").collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.want) for r in got]


def test_context_runs_until_another_section(spark):
    lines = [
        (1, 1, 0, "1.", None, "בחוק הבנקאות, התשמ״א–1981, בסעיף 5 –"), (1, 2, 1, None, None, "בסעיף 6, במקום"), (1, 3, 0, "2.", None, "בפקודת התעבורה, בסעיף 7 –"),
        (1, 4, 1, "", None, "אחרי סעיף 8 יבוא"), (1, 5, 0, "3.", None, "תחילתו, בסעיף 9"), (1, 6, 0, "4.", None, "בסעיף 10 לחוק העיקרי, בסעיף 5"), (1, 7, 0, "", None, "סעיף 11 – בטל"),
        (2, 1, 0, "1.", None, "בסעיף 10 לחוק העיקרי"), (3, 1, 0, "1.", None, None),
    ]
    df = spark.createDataFrame(lines, LINE).withColumn("law", F.lit("clash")).withColumn("place", F.lit(0))
    got = sorted((r.place, r.section) for r in cited_sections_of(df, ["at"]).collect())
    assert got == [(1, "5"), (2, "6"), (3, "10"), (4, "11")]
    assert {r.law for r in cited_sections_of(df, ["at"]).collect()} == {"חוק הבנקאות, התשמ״א–1981"}
    assert cited_sections_of(df.limit(0), ["at"]).count() == 0


def keyed(label):
    out, i = [], 0
    while i < len(label):
        j = i
        while j < len(label) and label[j].isdigit() == label[i].isdigit():
            j += 1
        out.append(int(label[i:j]) if label[i].isdigit() else SUFFIXES.index(label[i:j]) + 1)
        i = j
    return out


def test_labels_of_every_gap(spark):
    draw = random.Random(2)
    laws = {}
    for law in range(40):
        laws[law] = {str(draw.randint(1, 4)) + draw.choice(["", SUFFIXES[draw.randint(0, 3)]]) for _ in range(draw.randint(1, 14))}
        laws[law] |= {x + str(draw.randint(1, 3)) for x in list(laws[law]) if not x[-1].isdigit() and draw.random() < 0.5}
    rows = spark.createDataFrame([(k, n) for k, ns in laws.items() for n in ns for _ in range(2)], "law_id long, number string")
    got = {(r.law_id, r.number): r.label for r in insertion_labels(rows.withColumn("label", F.lit("clash")), ["law_id"]).collect()}
    assert len(got) == sum(map(len, laws.values()))
    for (law, number), label in got.items():
        taken = laws[law]
        assert label not in taken and keyed(label) > keyed(number)
        after = [n for n in taken if keyed(n) > keyed(number)]
        if not after:
            assert len(keyed(label)) == len(keyed(number))
        else:
            first = [number + (s if number[-1].isdigit() else str(i + 1)) for i, s in enumerate(SUFFIXES)]
            assert label == next(x for x in first if x not in taken)
            assert all(keyed(label) < keyed(n) for n in after if not n.startswith(number))


def test_labels_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "(א)", 1), (1, "(ב)", 3), (1, "(א1)", 2), (1, None, 4), (2, "x", 1), (None, "7", 1)], "u long, number string, at long")
    got = {(r.u, r.number): r.label for r in insertion_labels(rows, ["u"], "at").collect()}
    assert got == {(1, "(א)"): "(א2)", (1, "(א1)"): "(א1א)", (1, "(ב)"): "(ג)", (1, None): None, (2, "x"): None, (None, "7"): None}
    assert insertion_labels(rows.limit(0), ["u"]).count() == 0


def test_words_of_a_line_are_found_once(spark):
    """Findings of round 3, F14: lambdas that looked up neighbours split the line again for each of its words."""
    from lexmere.operators.citing import points_to_main

    df = spark.createDataFrame([("אחרי סעיף 5 לחוק העיקרי", "תיקון סעיף 7"), ("  בחוק   העיקרי", None), ("בפקודה", ""), ("בחוק אחר", "סעיף"), (None, None)], "text string, heading string")
    out = df.select(points_to_main(F.coalesce("text", F.lit(""))).alias("main"), cited_numbers(F.col("text"), F.col("heading")).alias("cited"))
    assert [(r.main, r.cited) for r in out.collect()] == [(True, ["7", "5"]), (True, []), (True, []), (False, []), (False, [])]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") <= 12
