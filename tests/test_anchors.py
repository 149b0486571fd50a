"""Anchors and spans: cases by hand, and random texts against rules stated by pattern."""

from __future__ import annotations

import random
import re

from lexmere.functions.spans import LETTERS, _inside, anchors, citations, references
from lexmere.operators.anchors import changeable, spans_of, text_anchors_of


def said(text, spans):
    return [text[s:e] for s, e in spans]


def test_references():
    cases = {
        "לפי סעיף 7 לחוק": ["סעיף 7"],
        "בסעיפים 143, 143א או 206 יבוא": ["בסעיפים 143, 143א או 206"],
        "סעיף 5, 30 ימים": ["סעיף 5"],
        "ובסעיף קטן (א) ו-(ב)": ["ובסעיף קטן (א) ו-(ב)"],
        "סעיף 22(ב)(1) וכן פסקת משנה (ג)": ["סעיף 22(ב)(1)", "פסקת משנה (ג)"],
        "סעיפים 3 עד 5 או 6 חודשים": ["סעיפים 3 עד 5"],
        'סעיף "7"': ['סעיף "7"'],
        "חלקה 7": [], "תקופה 30 ימים": [], "סעיף": [], "": [], "סעיף7": [], "אסעיף 7": [],
    }
    for text, want in cases.items():
        assert said(text, references(text)) == want, text


def test_citations():
    cases = {
        'לפי חוק חומרי נפץ (תיקון מס\' 4 – הוראת שעה), התשע"ח–2018, יבוא': ['חוק חומרי נפץ (תיקון מס\' 4 – הוראת שעה), התשע"ח–2018'],
        'פקודת הראיות התשל"א-1971': ['פקודת הראיות התשל"א-1971'],
        'חוק א, ב, התשע"ח–2018': [], "תקופה – 2018": [], "": [],
        "חוק" + " ב" * 60 + ', התשע"ח–2018': [],
    }
    for text, want in cases.items():
        assert said(text, citations(text)) == want, text


def test_kinds_of_values():
    text = 'בשנת 1954 ו-2010, תוך 30 ימים, סעיף 22ב, התשע"ח–2018, 12345, א7, 7_ 2020א'
    assert [(a.text, a.kind) for a in anchors(text)] == [
        ("1954", "gregorian_year"), ("2010", "gregorian_year"), ("30", "number"), ("22ב", "section_ref"), ('התשע"ח', "hebrew_year"), ("2018", "gregorian_year"), ("2020", "gregorian_year")]
    assert [a.text for a in anchors("תקופה ותקנות של תשלום")] == []
    assert [(a.text, a.in_reference) for a in anchors("סעיף 5, 30 ימים; 9א1")] == [("5", True), ("30", False), ("9א1", True)]


def test_values_against_patterns():
    """Numbers, years and labels of random texts, told by look-around patterns."""
    wide = r"\w֐-׿"
    rules = {"section_ref": rf"(?<![{wide}])([0-9]{{1,3}}[{LETTERS}]{{1,3}}[0-9]?)(?![{wide}])", "gregorian_year": r"(?<![0-9])((?:18|19|20)[0-9]{2})(?![0-9])", "number": rf"(?<![{wide}])([0-9]{{1,4}})(?!\w)"}
    draw = random.Random(5)
    for _ in range(20_000):
        text = "".join(draw.choice(["1", "8", "20", "9", "א", "ב", " ", ",", "־", "״", "x", "_"]) for _ in range(draw.randint(0, 14)))
        want: dict = {}
        for kind, rule in rules.items():
            for m in re.finditer(rule, text):
                want.setdefault(m.span(1), kind)
        got = {(a.start, a.end): a.kind for a in anchors(text)}
        assert got == want, text
        assert [a.start for a in anchors(text)] == sorted(a.start for a in anchors(text))


def test_sweep_against_all_pairs():
    draw = random.Random(6)
    for _ in range(2_000):
        cuts = sorted(draw.sample(range(60), 2 * draw.randint(0, 6)))
        spans = list(zip(cuts[::2], cuts[1::2]))
        places = sorted((s, s + draw.randint(1, 4)) for s in draw.choices(range(60), k=8))
        assert _inside(spans, places) == [any(s <= a and b <= e for s, e in spans) for a, b in places]


def test_long_text_is_read_in_linear_time():
    text = 'סעיף 7, 8 ו-9 לחוק הבנקאות, התשע"ח–2018. ' * 20_000
    assert len(anchors(text)) == 100_000


def test_operators_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "סעיף 7 תוך 8", "x"), (3, "סעיף 7 תוך 8", "x"), (None, "😀 9", "x")], "id long, text string, start string")
    got = sorted(((r.id or 0, r.start, r.end, r.text, r.in_reference) for r in text_anchors_of(rows).collect()))
    assert got == [(0, 2, 3, "9", False), (3, 5, 6, "7", True), (3, 5, 6, "7", True), (3, 11, 12, "8", False), (3, 11, 12, "8", False)]
    assert [r.text for r in changeable(text_anchors_of(rows.where("id = 3"))).collect()] == ["8", "8"]
    assert [(r.start, r.end, r.kind) for r in spans_of(rows).collect()] == [(0, 6, "reference")] * 2
    assert text_anchors_of(rows.limit(0)).count() == 0
