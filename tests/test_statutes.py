from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexmere.sources.statute import classified, conservation, first_call, line_rows, logical_lines, readable, template_names


def read(spark, *bodies):
    return spark.createDataFrame([(str(k), b, "x") for k, b in enumerate(bodies)], "doc_id string, body string, zone string")


def kinds(spark, body):
    return [(r.place, r.n, r.kind, r.use) for r in classified(line_rows(read(spark, body))).orderBy("place").collect()]


def test_calls():
    assert first_call("{{a|b|{{c|d}}|}} rest") == ("a", ["b", "{{c|d}}", ""], "rest")
    assert first_call("{{a|b") == (None, [], "") and first_call("{{a}}") == ("a", [], "")


def test_every_line_is_in_one_row():
    draw = random.Random(3)
    forms = ["", "plain", "{{ח:סעיף|1|", "}}", "{{ח:ת}} x", "<table>", "</table>", '<div class="law-toc">', "</div>", "{{ח:מבוא}}", "{{ח:סוגר}}", "{{a|{{b}}"]
    for _ in range(500):
        lines = [draw.choice(forms) for _ in range(draw.randrange(0, 12))]
        seen = [p for place, n, *_ in logical_lines("\n".join(lines)) for p in range(place, place + n)]
        assert len(seen) == len(set(seen)) and {k for k, x in enumerate(lines) if x} <= set(seen)


def test_zones(spark):
    assert kinds(spark, "{{ח:חתימות}}\nname\n{{ח:הערה|x}}\n{{ח:סוגר}}\nafter") == [(0, 1, "box", None), (1, 1, "box", None), (2, 1, "box", None), (3, 1, "box", None), (4, 1, "continuation", None)]
    assert kinds(spark, '<div class="law-toc">\n<table>\n</div>\n.') == [(0, 3, "contents", None), (3, 1, "punctuation", None)]
    assert kinds(spark, "{{ח:ת}} <TABLE>\nא\n</table >\n<table>\n\nב") == [(0, 3, "content", None), (3, 3, "raw_block", None)]
    assert kinds(spark, "{{ח:כותרת|לוח}}\n[[קטגוריה:חוקים]]\n{{חדש}}\n{{חדש|\nב}}\n{{לא נגמר\nסוף") == [(0, 1, "title", None), (1, 1, "category", None), (2, 1, "unknown", None), (3, 2, "raw_block", None), (5, 1, "unclosed", None), (6, 1, "continuation", None)]
    assert kinds(spark, "") == [] and line_rows(read(spark, None)).count() == 0 and line_rows(read(spark).limit(0)).count() == 0


def test_starred(spark):
    cases = [
        ("{{ח:סעיף*||עוגן=סעיף 30.ב}}", "subsection"), ("{{ח:סעיף*|7||עוגן=סעיף 30.ב}}", "ambiguous"), ("{{ח:סעיף*||עוגן=סעיף 57ג}}", "section"), ("{{ח:סעיף*||עוגן=סעיף פרק כא תוספת פרט 1}}", "list_item"), ("{{ח:סעיף*||עוגן=נספח}}", "unknown"),
        ("{{ח:סעיף*}}\n\n{{ח:תתת|(2)}} א", "subsection"), ("{{ח:סעיף*}}\nטקסט", "unknown"), ("{{ח:סעיף*}}", "unknown"),
    ]
    for body, use in cases:
        assert kinds(spark, body)[0][3] == use
    assert kinds(spark, "{{ח:קטע2|תוספת ראשונה}}\n{{ח:סעיף*}}\n{{ח:תת|(א)}} א")[1][3] == "unknown"


def test_ids(spark):
    rows = classified(line_rows(read(spark, "{{ח:סעיף|3|}}\n{{ח:סעיף*}}\n{{ח:ת}} אבטיח\n{{ח:סעיף|3|}}\n{{ח:סעיף*}}\n{{ח:ת}} אבטיח\n{{ח:סעיף*}}")))
    ids = [r.id for r in rows.where("id IS NOT NULL").orderBy("place").collect()]
    assert ids[0] == "n-3" and ids[2] == "n-3~2" and ids[1].startswith("c-") and ids[3] == ids[1] + "~2" and ids[4] == "p-6"


def test_losses(spark):
    docs = read(spark, '<div class="law-toc">\n{{ח:סעיף|9|}}\n</div>\n{{ח:סעיף|1|}}\n{{ח:ת}} א\n{{חדש|\nב}}', None, "{{זר|x}}\n{{ח:סעיף*|7||עוגן=סעיף 30.ב}}")
    rows = classified(line_rows(docs))
    got = lambda kept: {(r.doc_id, r.problem, r.place) for r in conservation(docs, kept).collect()}
    known = {("2", "unknown template", 0), ("2", "ambiguous section", 1)}
    assert got(rows) == known
    assert got(rows.where("NOT (doc_id = '0' AND place = 3)")) == known | {("0", "line lost", 3), ("0", "section count", None)}
    assert got(rows.where("NOT (doc_id = '0' AND place = 5)")) == known | {("0", "line lost", 5), ("0", "line lost", 6), ("0", "merged blocks", None)}
    assert {p for _, p, _ in got(rows.where("doc_id = '2'"))} >= {"line lost", "section count", "merged blocks"}


def test_readable(spark):
    cases = [("x<sup>2</sup> <SUB>a1</SUB> <sup>*</sup>", "x² ₐ₁ *"), ("העניין <s>של הכנסת</s>, הוראות", "העניין, הוראות"), ("פרט <s>(</s>5<s>)</s>", "פרט 5"), ("[[קובץ:א.svg|ממוזער]]<br>ב<wbr>ג", "[תמונה: א]\nבג"), ("<span class='x'>א</span>", "א"), ("", ""), (None, None)]
    got = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, w string").select("k", readable(F.col("t")).alias("g"), "w").orderBy("k").collect()
    assert [r.g for r in got] == [r.w for r in got]
    assert spark.createDataFrame([("{{א|{{ב}}}} {{ ג }}",)], "t string").select(template_names(F.col("t")).alias("n")).first().n == ["א", "ב", "ג"]
