"""Checks of drafts by hand: forms of headings and titles, the name of the main law, odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmere.operators.checks import draft_findings, heading_is_known, is_tail, title_amends, unanchored

LINES = "bill_id long, place long, depth long, number string, heading string, text string, quoted boolean, footnotes array<string>"


def test_headings_and_titles(spark):
    headings = {
        "תיקון סעיף 110": True, "הוספת סעיף 9א2": True, "תיקון סעיף 5(א)": False, "תיקון סעיף": False, "הוספת פרק ט'1": True, "תיקון התוספת": True, "הוספת סעיפים 2ג ו־2ד": True,
        "תיקון פקודת התעבורה": True, "ביטול חוק־יסוד": True, "תחולה על מקומות כליאה": True, "הוראות מעבר": True, "הוראות שונות": False, "עניין": False, "החלפת לוח השוואה": True, "תיקון תקנות": False,
    }
    rows = spark.createDataFrame(list(headings.items()), "h string, want boolean")
    assert [r.h for r in rows.where(heading_is_known(F.col("h")) != F.col("want")).collect()] == []
    tails = {"תחילה": True, "דיווח לכנסת": True, "תיקון חוק כביש אגרה": True, "צו ראשון לקביעה": True, "תיקון סעיף 4": False, "הגדרות": False}
    rows = spark.createDataFrame(list(tails.items()), "h string, want boolean")
    assert [r.h for r in rows.where(is_tail(F.col("h")) != F.col("want")).collect()] == []
    year = ', התשפ"ו–2026'
    titles = {
        "הצעת חוק הבנקאות (תיקון – עמלות)" + year: True, "הצעת חוק הבנקאות (תיקון מס' 12) (עמלות)" + year: True, "הצעת חוק הבנקאות (תיקון מס׳7)" + year: True, "הצעת חוק א (תיקוני חקיקה)" + year: True,
        "הצעת חוק לתיקון פקודת התעבורה (קנס)" + year: True, "הצעת חוק הבנקאות" + year: False, "הצעת חוק הבנקאות (תיקון – עמלות)": False, "חוק א (תיקון – ב)" + year: False, "הצעת חוק א (תיקון – )" + year: False, "": False,
    }
    rows = spark.createDataFrame(list(titles.items()), "h string, want boolean")
    assert [r.h for r in rows.where(title_amends(F.col("h")) != F.col("want")).collect()] == []


def found(spark, lines, kind="amending", submitted="2026-01-05", title="הצעת חוק הבנקאות (תיקון – עמלות), התשפ\"ו–2026", refs=(), sections=()):
    bills = spark.createDataFrame([(1, kind, title, submitted, "x"), (1, kind, title, submitted, "x"), (None, kind, title, submitted, "x")], "bill_id long, kind string, title string, submitted string, status string")
    rows = [(1, i, 0 if n else 1, n, h, t, q, list(f)) for i, (n, h, t, q, f) in enumerate(lines)]
    out = draft_findings(bills, spark.createDataFrame(rows, LINES).withColumn("number_of", F.lit(1)), spark.createDataFrame([(1, r) for r in refs], "bill_id long, key string"), spark.createDataFrame([(1, s) for s in sections], "bill_id long, section string"))
    got = {r.number: (r.status, r.n_bad) for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12]
    return got


def test_a_sound_bill_and_its_faults(spark):
    law = ("1.", "תיקון סעיף 5", 'בחוק הבנקאות, התשמ"א–1981 (להלן – החוק העיקרי), בסעיף 5 –', False, ["a"])
    next_ = ("2.", "תיקון סעיף 6א", "בסעיף 6א לחוק העיקרי", False, [])
    end = ("3.", "תחילה", "תחילתו של חוק זה", False, [])
    good = found(spark, [law, next_, end], refs=["a"], sections=["5", "6א"])
    assert {s for s, _ in good.values()} == {"passed"} and {n for _, n in good.values()} == {0}
    bad = found(spark, [end, next_, law, ("4.", "דבר", "״", False, ["b"])], sections=["5"], submitted="2025", title="הצעת חוק הבנקאות")
    assert {k: v[0] for k, v in bad.items()} == {1: "passed", 2: "failed", 3: "passed", 4: "failed", 5: "failed", 6: "passed", 7: "failed", 8: "failed", 9: "failed", 11: "passed", 12: "failed"}
    assert bad[2] == ("failed", 2)
    early = found(spark, [("1.", "תיקון סעיף 5", "כאמור בהחוק העיקרי", False, []), law])
    assert early[3] == ("failed", 1) and early[1] == ("not checked", None)
    new = found(spark, [], kind="new", submitted=None)
    assert [new[k][0] for k in (1, 3, 4, 7, 8, 2, 5, 12)] == ["not checked"] * 5 + ["passed"] * 3


def test_terms_dashes_and_malformed_numbers(spark):
    lines = [
        (None, None, 'אחרי ההגדרה "הבנק" יבוא:', False, []), (None, None, '"אגרה" – כהגדרתה', True, []), (None, None, 'אחרי ההגדרה "אגרה" יבוא:', False, []), (None, None, '"הבנק" – התשמ"א-1981', True, []),
        ("1.", "תיקון סעיף חמישי", 'לשנים 2009 ו-2010, התשס"ט-2009', False, []), (None, None, None, None, []),
    ]
    got = found(spark, lines)
    assert got[11] == ("warning", 1) and got[6] == ("failed", 1) and got[9] == ("not checked", None)


def test_explanations_point_to_named_lines(spark):
    said = spark.createDataFrame([(1, "בשורה 42 ובשורות 2, 3 ו-4"), (2, "שורה 7"), (3, "בלי מקום 9"), (4, None), (5, "שורה 007")], "id long, text string")
    named = spark.createDataFrame([(1, "42, 2, 3"), (2, "נמצא ב-7"), (5, "7")], "id long, message string")
    assert [(r.id, r.lines) for r in unanchored(said, named).collect()] == [(1, ["4"])]
