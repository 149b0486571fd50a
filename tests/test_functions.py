from __future__ import annotations

from pyspark.sql import functions as F

from lexmere.functions import numbering, text
from lexmere.operators.matching import resolve_titles
from lexmere.operators.retrieval import fuse, search_titles
from lexmere.operators.versions import apply_edits, word_edits
from lexmere.sources.markup import parse, parse_documents, sanity_checks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_titles(spark):
    lit = F.lit
    assert one(spark, text.straight_quotes(lit("בית־ספר ״א״"))) == 'בית-ספר "א"'
    assert one(spark, text.without_vowel_letters(lit("ו חוק יסוד"))) == "ו חק יסד"
    assert one(spark, text.search_form(lit('חוק-יסוד: הכנסת, התשל"ז-1977'))) == 'חק יסד הכנסת תשל"ז-1977'
    assert one(spark, text.compact_form(lit("בין לאומית ם"))) == "בינלאומיתמ"
    assert one(spark, text.base_title(lit("חוק העונשין, תשל״ז–1977 [נוסח חדש]"))) == "חוק העונשין"
    assert one(spark, text.base_title(lit("פקודה [נוסח] א-ב"))) == "פקודה א ב" and one(spark, text.base_title(lit("חוק, 1977"))) == "חוק, 1977"
    assert one(spark, text.search_form(lit("בין-לאומי: (התש\"ם-1980)"))) == 'בן לאמ (תש"ם-1980)'
    assert one(spark, text.content_words(lit("על (תיקון) תיקון, התשפד 1999 גן"), ["תיקון"])) == []
    assert one(spark, text.title_year(lit("חוק, תשל״ז–1977 [נוסח]"))) == "1977" and one(spark, text.display_date(lit("2026-12-01 00:00"))) == "01.12.2026"
    assert one(spark, text.title_year(lit("חוק, תשל״ז–1977"))) == "1977" and one(spark, text.title_year(lit("חוק"))) is None
    assert one(spark, text.display_date(lit("2024-09-30T13:00:35"))) == "30.09.2024" and one(spark, text.display_date(lit("soon"))) == "soon"
    assert one(spark, text.sentences(lit("One. Two?  Three"))) == ["One.", "Two?", "Three"]
    assert one(spark, text.word_count(lit(" 12. three more words"))) == 3


def test_terms(spark):
    def hits(term, title):
        return one(spark, text.term_matches(term, F.lit(title)))

    assert hits("חקלא", "תמיכה בחקלאות") and hits("בתי דין", "סמכות בבתי הדין") and hits("נווה-שלום", "גן נווה שלום")
    assert not hits("ירוק", "פירוקים") and hits("גז", "בגז") and not hits("גז", "הגזירה")
    assert one(spark, text.facets_match([], F.lit("x"))) and not one(spark, text.facets_match([["a"], ["b"]], F.lit("a c")))


def test_numbers(spark):
    labels = ["5", "4א1", "3יא", "4", "34כד", "3", "4ב", "3א", "51ח1", "4א", "34ל"]
    rows = spark.createDataFrame([(x,) for x in labels], "n string").orderBy(numbering.section_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["3", "3א", "3יא", "4", "4א", "4א1", "4ב", "5", "34כד", "34ל", "51ח1"]
    assert one(spark, numbering.section_key(F.lit("א4"))) is None and one(spark, numbering.section_key(F.lit("4 א"))) is None
    taken = F.array(F.lit("6א"), F.lit("ג1"))
    assert one(spark, numbering.next_inserted(F.lit("6"), taken)) == "6ב" and one(spark, numbering.next_inserted(F.lit("ג"), taken)) == "ג2"
    assert [one(spark, numbering.next_appended(F.lit(x))) for x in ("6", "4א", "4א1", "ט")] == ["7", "4ב", "4א2", "י"]


def test_resolution(spark):
    authority = spark.createDataFrame([(1, "חוק א, תש״ך-1960", "v"), (2, "חוק ב", "v"), (3, "חוק ב", "x"), (4, "חוק ג", "x"), (5, "חוק ג", "x"), (6, "חק ד", "v")], "auth_id long, name string, s string")
    titles = [(1, "חוק א", "חוק א, תש״ך–1960"), (2, "חוק א", "חוק א, תשכ״א–1961"), (3, "חוק ב", "חוק ב"), (4, "חוק ג", "חוק ג"), (5, "חוק ד", "חוק ד"), (6, "חוק ה", "חוק ה")]
    got = {r.id: (r.status, r.auth_id) for r in resolve_titles(spark.createDataFrame(titles, "id long, title string, full_title string"), authority, F.col("s") == "v").collect()}
    assert got == {1: ("exact", 1), 2: ("not_found", None), 3: ("exact", 2), 4: ("ambiguous", None), 5: ("normalized", 6), 6: ("not_found", None)}


def test_search(spark):
    titles = spark.createDataFrame([(1, "חוק-יסוד: הכנסת"), (2, "חוק יסודות המשפט"), (3, "הסכם בין-לאומי"), (4, "כנסת חדשה חוק")], "id long, title string")
    assert [r.id for r in search_titles(titles, "חוק יסוד").collect()] == [1, 2]
    assert [r.id for r in search_titles(titles, "בינלאומי").collect()] == [3]
    assert [r.id for r in search_titles(titles, "הכנסת חוק").collect()] == [1] and search_titles(titles, "  ").count() == 0


def test_fusion(spark):
    def listed(titles, units, facets=[]):  # noqa: B006
        rows = spark.createDataFrame([(i, x, i) for i, x in enumerate(titles)], "id long, title string, newest long")
        return [(r.id, r.stage, r.matched) for r in fuse(rows, units, facets, 16).orderBy("place").collect()]

    # 40 rows: six of the budget, then a tail of four; the unit of one word only counts as a match
    assert listed(["old mill"] * 40, ["old mill"]) == [(i, 0, 1) for i in range(39, 33, -1)] + [(i, 2, 1) for i in range(33, 29, -1)]
    assert listed(["old mill"] * 3, ["mill"]) == [] and listed(["old mill", None] * 2, ["mill"], [["old"], ["mill"]]) == [(2, 0, 1), (0, 0, 1)]
    # a unit goes on where the first one's budget ends, and rows of two units come before the tail
    got = listed(["old mill"] * 30 + ["old mill road"] * 10, ["mill road", "old mill"])
    assert [r[0] for r in got] == [*range(39, 29, -1), 29, 28, 27, 26, 25, 24] and [r[1] for r in got] == [0] * 12 + [2] * 4
    assert listed(["a b"] * 121, ["a b"]) == [] and listed(["a b c"] * 61, ["a b", "b c"]) == [(i, 1, 2) for i in range(60, 48, -1)]


def test_edits(spark):
    assert word_edits("a b c", "a x c d") == [{"op": "replace", "old": "b", "new": "x", "at": 1}, {"op": "insert", "old": "", "new": "d", "at": 3}]
    nodes = spark.createDataFrame([(k, i, f"t{i}", p) for k in (1, 2, 3) for p, i in enumerate("abc")], "law long, id string, text string, place long")
    edits = [(1, 1, "replace", "b", "new"), (1, 2, "insert_after", "b", "more"), (1, 3, "delete", "a", ""), (2, 1, "delete", "a", ""), (2, 2, "delete", "a", "")]
    got = apply_edits(nodes, spark.createDataFrame(edits, "law long, seq int, op string, target string, text string")).orderBy("law", "place").collect()
    assert [(r.id, r.text) for r in got if r.law == 1] == [("b", "new"), ("b+2", "more"), ("c", "tc")]
    assert [r.id for r in got if r.law == 2] == list("abc") and {r.error for r in got if r.law == 2} == {"edit 2: no a"}
    assert [r.id for r in got if r.law == 3] == list("abc") and {r.error for r in got if r.law == 3} == {None}


MARKUP = """{{preamble}}
signed by {{x|nobody}}
{{end}}
{{chapter|1|General}}
{{section|1|Terms|amended: X-2}}
{{text1|In this law {{term|goods}} are things.}}
{{text2|(1)|first}}
{{text2|(2)|second
line}}
{{note|an editor's note}}
{{section|1|Again}}
{{text1|other}}
<table><tr></tr></table>
"""


def test_markup(spark):
    rows = parse("d", MARKUP)
    kinds = [(r[5], r[6], r[4]) for r in rows]
    assert kinds[:4] == [("law", "", 0), ("chapter", "1", 1), ("section", "1", 2), ("paragraph", "", 3)]
    assert rows[3][8] == "In this law goods are things." and rows[2][9] == "amended: X-2"
    assert [(r[6], r[4]) for r in rows if r[5] == "paragraph"][1:3] == [("(1)", 4), ("(2)", 4)]
    assert len({r[1] for r in rows}) == len(rows) and rows[-1][5] == "raw_block" and not rows[-1][10]
    assert not any("nobody" in (r[8] or "") for r in rows)
    docs = spark.createDataFrame([("d", MARKUP), ("bad", "{{section|1"), ("none", None)], "doc_id string, body string")
    problems = {(r.doc_id, r.problem) for r in sanity_checks(parse_documents(docs)).collect()}
    assert ("bad", "not parsed: a template call doesn't end") in problems and ("none", "no normative content") in problems
    assert not any(d == "d" for d, _ in problems)
