from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmere.operators.edits import edit_kind, edit_kinds, edited, insert_ignore, upsert


def test_kinds(spark):
    cases = [("a b c", "a x b c", "insert_after"), ("a b.", "z a b.", "insert_before"), ("a b.", "a b c.", "append"), ("a b c", "a c", "delete"), ("a b a c", "a b a d", "replace"), ("a", "a", "unsupported"), ("a b a b", "a b", "unsupported"), (None, "x", "unsupported")]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(cases)], "id long, before string, after string")
    got = {r.id: r for r in edit_kinds(rows).collect()}
    assert [got[i].kind for i in range(len(cases))] == [c[2] for c in cases]
    assert (got[0].phrase, got[0].text) == ("a ", "x ")
    assert (got[4].phrase, got[4].text) == ("c", "d") and got[3].phrase == "b"


PIECES = st.lists(st.sampled_from(["a", "b", "cd", "e.", " ", " ", ".", ", ", "; ", "\n"]), max_size=14)


@settings(max_examples=1500, deadline=None)
@given(PIECES, st.integers(0, 14), st.integers(0, 3), st.lists(st.sampled_from(["a", "x", " ", ".", " y "]), max_size=4))
def test_edits_lead_to_the_text_after(pieces, at, gone, came):
    """A text and one edit of it: whatever is told leads exactly to the text after."""
    before, after = "".join(pieces), "".join(pieces[:at] + came + pieces[at + gone :])
    kind, phrase, text = edit_kind(before, after)
    if kind != "unsupported":
        assert phrase is None or before.count(phrase) == 1
        assert edited(before, kind, phrase, text) == after


def test_marks_keep_their_place():
    assert edit_kind("Sec. one.", "Sec. one More.") == ("append", None, " More")
    assert edited("Sec. one.", *edit_kind("Sec. one.", "Sec. one. More")) == "Sec. one. More"
    assert edit_kind("a.", "a.b")[0] != "unsupported" and edited("a.", *edit_kind("a.", "a.b")) == "a.b"
    assert edited(". a b", *edit_kind(". a b", "x . a b")) == "x . a b"


def test_stores(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id long, v string")
    assert sorted(r.v for r in upsert(base, new, ["id"]).collect()) == ["B", "C", "N", "a"]
    assert sorted(r.v for r in insert_ignore(base, new, ["id"]).collect()) == ["C", "a", "b", "n"]
