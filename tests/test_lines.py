from __future__ import annotations

from lexmere.operators.documents import unconsumed_lines


def test_zones_and_kinds(spark):
    text = "First part\n\n{| class=x\ncell.\n|}\nsecond part.\n{{call|x}}\ncopied\nwas copied here\n<table><tr></table>\n[[Category:x]]\nlast"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.line_no, r.kind) for r in unconsumed_lines(docs).orderBy("line_no").collect()]
    assert got == [(0, "standalone"), (5, "continuation"), (7, "duplicate"), (8, "continuation"), (11, "continuation")]
