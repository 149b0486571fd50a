from __future__ import annotations

from lexmere.operators.documents import quote_verdicts


def test_short_quotes(spark):
    docs = [(1, "The committee may extend the term by the end. Next"), (2, "Another text altogether"), (3, None)]
    quotes = ["committee", "ommittee may ext", "the term", "extend the term by", "committee may extend the term by the end", "COMMITTEE may extend the", "NEXT", "term the", "no such words in here at all", "Another text altogether", "", None]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = {r.item_id: r.verdict for r in quote_verdicts(q, d).collect()}
    texts = [t for _, t in docs if t is not None]
    for i, x in enumerate(quotes):
        exact = x is not None and any(x in t for t in texts)
        loose = x is not None and any(x.lower() in t.lower() for t in texts)
        assert got[i] == ("exact" if exact else "typography" if loose else "missing"), x
