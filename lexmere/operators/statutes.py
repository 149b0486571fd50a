"""Queries over statutes in published markup, made from the texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.plans.registry import Tables, query
from lexmere.sources.statute import classified, conservation, line_rows, readable

_OPEN = '{{ח:מבוא}}\nהקדמה\n{{ח:סוגר}}\n<div class="law-toc">\n{{ח:פנימי|1}}\n</div>\n'
#: By the piece's number and the document's: what stands before and behind it.
_FORMS = (("{{ח:סעיף|", ""), ("{{ח:ת}} ", ""), ("{{ח:סעיף*||עוגן=סעיף 3.ב}}\nהמשך ", ""), ("{{ח:תת|(א)}} ", ""), ("{{ח:סעיף*}}\n{{ח:תת|(1)}} ", ""), ("{{ח:סעיף*}}\n{{ח:ת}} ", ""), ("<table>\n<tr>", "</tr>\n</table>"), ("{{לוח חדש|\n", "}}"))

#: Space characters of any kind, which a piece doesn't begin or end with.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def markup(t: Tables) -> DataFrame:
    """Documents as statutes: a box and a table of contents, then a form for each piece of the text."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[{}|<>\[\] \t\n\f\r]+", " ")
    pieces = F.filter(F.transform(F.split(text, r"\. "), lambda p: F.trim(p, F.lit(_SPACES))), lambda p: F.length(p) > 1)
    at = lambda i: F.pmod(i + F.col("doc_id"), F.lit(len(_FORMS))).cast("int")
    before, behind = (F.lit([f[k] for f in _FORMS]) for k in (0, 1))
    form = lambda p, i: F.concat(F.get(before, at(i)), F.when(at(i) == 0, F.concat(i.cast("string"), F.lit("|"), p, F.lit("}}"))).otherwise(F.concat(p, F.get(behind, at(i)))))
    return t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit(_OPEN), F.array_join(F.transform(pieces, form), "\n")).alias("body"))


_PIECES = r"""
d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[{}|<>\[\]\s]+', ' ', 'g'), '. '), lambda p: trim(p)), lambda p: length(p) > 1) AS ps FROM documents),
p AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS i FROM d),
f AS (SELECT *, (i + doc_id) % 8 AS k, [1, 1, 2, 1, 2, 2, 3, 2][(i + doc_id) % 8 + 1] AS n FROM p),
g AS (SELECT *, 6 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM f),
r AS (
  SELECT doc_id, unnest([0, 1, 2, 3]) AS place, unnest([1, 1, 1, 3]) AS n, unnest(['box', 'box', 'box', 'contents']) AS kind, NULL AS use, NULL AS id FROM d
  UNION ALL SELECT doc_id, place, 1, 'section', 'section', 'n-' || i FROM g WHERE k = 0
  UNION ALL SELECT doc_id, place, 1, 'content', NULL, NULL FROM g WHERE k IN (1, 3)
  UNION ALL SELECT doc_id, place, 1, 'section', 'subsection', 'p-' || place FROM g WHERE k = 2
  UNION ALL SELECT doc_id, place + 1, 1, 'continuation', NULL, NULL FROM g WHERE k = 2
  UNION ALL SELECT doc_id, place, 1, 'section', CASE k WHEN 4 THEN 'subsection' ELSE 'unknown' END, 'c-' || substr(sha256(x), 1, 8) FROM g WHERE k IN (4, 5)
  UNION ALL SELECT doc_id, place + 1, 1, 'content', NULL, NULL FROM g WHERE k IN (4, 5)
  UNION ALL SELECT doc_id, place, n, 'raw_block', NULL, NULL FROM g WHERE k IN (6, 7))
"""


@query(f"""
WITH {_PIECES}
SELECT doc_id::VARCHAR AS doc_id, place::INT AS place, n, kind, use, CASE WHEN c > 1 THEN id || '~' || c ELSE id END AS id
FROM (SELECT *, CASE WHEN id IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, id ORDER BY place) END AS c FROM r)""")
def statute_rows(t: Tables) -> DataFrame:
    """What each line of a statute is, with the ids of its sections."""
    return classified(line_rows(markup(t))).select("doc_id", "place", "n", "kind", "use", "id")


@query(f"""
WITH {_PIECES}, l AS (SELECT * FROM g WHERE k = 0 AND i % 16 = 0),
s AS (SELECT doc_id, count(*) FILTER (k IN (0, 2, 4, 5)) AS n FROM g GROUP BY 1), m AS (SELECT doc_id, count(*) AS c FROM l GROUP BY 1)
SELECT doc_id::VARCHAR AS doc_id, 'line lost' AS problem, place::INT AS place, '{{{{ח:סעיף|' || i || '|' || x || '}}}}' AS detail FROM l
UNION ALL SELECT doc_id::VARCHAR, 'section count', NULL, n || ' against ' || (n - c) FROM s JOIN m USING (doc_id)""")
def statute_losses(t: Tables) -> DataFrame:
    """Sections planted as lost, every one whose number 16 divides: each is found, named, and missed in its document's count."""
    docs = markup(t)
    rows = classified(line_rows(docs))
    planted = (F.col("name") == "ח:סעיף") & (F.col("number").try_cast("long") % 16 == 0)
    return conservation(docs, rows.where(~F.coalesce(planted, F.lit(False))))


@query(r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'm³ ' || x WHEN 1 THEN x || ' (סוף)' WHEN 2 THEN '[תמונה: map] ' || x ELSE x || chr(10) || 'H₂O' END AS text
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{}|<>\[\]]+', ' ', 'g') AS x FROM documents)""")
def readable_texts(t: Tables) -> DataFrame:
    """Texts without their inline markup: raised and lowered digits, struck words, images, breaks."""
    x = F.regexp_replace(F.coalesce("text", F.lit("")), r"[{}|<>\[\]]+", " ")
    k = F.pmod("doc_id", F.lit(4))
    marked = (
        F.when(k == 0, F.concat(F.lit("m<sup>3</sup> <b>"), x, F.lit("</b>")))
        .when(k == 1, F.concat(x, F.lit(" <s>נמחק</s> (סוף)")))
        .when(k == 2, F.concat(F.lit("[[File:map.png|thumb]] "), x))
        .otherwise(F.concat(x, F.lit("<br/>H<sub>2</sub>O")))
    )
    return t.documents.select("doc_id", readable(marked).alias("text"))
