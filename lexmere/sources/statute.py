"""Statutes in their published markup, line by line: what each line is, and whether every line has come through.

A document's lines become rows (doc_id, place, n, text, zone, name, args, rest): a template call that goes on over
several lines is one row, as are a table, kept whole, and a table of contents. Blank lines are no rows. What a row is
follows from it and from the rows beside it, by windows over a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of templates by what they do, words in anchors of list items, and what opens and closes blocks.
TITLE, SECTION, STARRED = "ח:כותרת", "ח:סעיף", "ח:סעיף*"
HEADINGS = ("ח:קטע1", "ח:קטע2", "ח:קטע3", "ח:קטע4", "ח:קטע5")
CONTENT = r"^ח:ת{1,7}$"
BOXES, BOX_END = ("ח:פתיח-התחלה", "ח:חתימות", "ח:מבוא"), "ח:סוגר"
BENIGN = ("ח:התחלה", "ח:סוף", "ח:פתיח-סוגר", "ח:מאגר", "ח:מאגר2", "ח:תיבה", "ח:מפריד", "ח:הערה", "ויקיפדיה", "מיזמים", "צבע גופן")
LIST_WORDS = "תוספת|לוח|טופס|פרט|חלק"
CONTENTS_START, CONTENTS_END = '<div class="law-toc">', "</div>"
SUPERSCRIPTS = ("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ")
SUBSCRIPTS = ("0123456789+-=()aeoxhklmnpst", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ")

ROWS = "doc_id string, place int, n int, text string, zone string, name string, args array<string>, rest string"
_MARK = re.compile(r"\{\{|\}\}|\|")
_TABLE, _TABLE_END = re.compile(r"<table\b", re.I), re.compile(r"</table\s*>", re.I)


def first_call(text: str) -> tuple[str | None, list[str], str]:
    """The template call that opens a text (name, arguments) and what stands behind it; no name if it doesn't end."""
    parts, depth, cut = [], 0, 2
    for m in _MARK.finditer(text):
        if m[0] == "|":
            if depth == 1:
                parts.append(text[cut : m.start()].strip())
                cut = m.end()
            continue
        depth += 1 if m[0] == "{{" else -1
        if depth == 0:
            parts.append(text[cut : m.start()].strip())
            return parts[0], parts[1:], text[m.end() :].strip()
    return None, [], ""


def _ends(lines: list[str]) -> list[int]:
    """For each line the last line of what it opens: where the braces are back at its level; itself if they never are."""
    level = [0]
    for line in lines:
        level.append(level[-1] + line.count("{{") - line.count("}}"))
    out, waiting = list(range(len(lines))), []
    for k, now in enumerate(level):
        while waiting and now <= level[waiting[-1]]:
            start = waiting.pop()
            out[start] = k - 1
        waiting.append(k)
    return out


def logical_lines(body: str) -> Iterator[tuple]:
    """(place, number of lines, text, zone, name, arguments, rest), in time that grows with the text."""
    lines = body.split("\n")
    ends, at, box = _ends(lines), 0, False
    closes = {"table": [len(lines) - 1] * (len(lines) + 1), "contents": [len(lines) - 1] * (len(lines) + 1)}
    for k in range(len(lines) - 1, -1, -1):
        closes["table"][k] = k if _TABLE_END.search(lines[k]) else closes["table"][k + 1]
        closes["contents"][k] = k if lines[k].strip() == CONTENTS_END else closes["contents"][k + 1]
    while at < len(lines):
        line, end, zone, name, args, rest = lines[at].strip(), at, "box" if box else "body", None, [], ""
        if line == CONTENTS_START:
            zone, end = "contents", closes["contents"][at]
        elif _TABLE.match(line):
            zone, end = "table", closes["table"][at]
        elif line.startswith("{{"):
            end = ends[at]
            name, args, rest = first_call("\n".join(lines[at : end + 1]).strip())
            if _TABLE.match(rest):
                end = closes["table"][end]
                rest = first_call("\n".join(lines[at : end + 1]).strip())[2]
            box = name in BOXES or (box and name != BOX_END)
        if line:
            yield at, end - at + 1, "\n".join(lines[at : end + 1]).strip(), zone, name, args, rest
        at = end + 1


def line_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id string, body; other columns don't count): the rows of their lines. Null and empty bodies have none; a
    table or contents that don't end go to the end of the document; a call that doesn't end is its first line alone,
    without a name."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, *row) for d, body in zip(pdf["doc_id"], pdf["body"], strict=True) for row in logical_lines(body or "")]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")], dtype=object)

    return docs.select("doc_id", "body").mapInPandas(each, ROWS)


def classified(rows: DataFrame) -> DataFrame:
    """Rows with kind, use and id.

    A starred section is told by its anchor: a list item by its words, a subsection by a dot behind the number, else a
    section; without an anchor it is a subsection if content of the second or third level follows within the law itself,
    else unknown. A subsection with a number of its own is ambiguous. An id comes from the number, else from the content
    that follows, else from the place; repeated ones are counted on."""
    doc = Window.partitionBy("doc_id").orderBy("place")
    name = F.coalesce("name", F.lit(""))
    anchor = F.get(F.filter("args", lambda a: a.startswith("עוגן=")), F.lit(0))
    value = F.trim(F.substr(anchor, F.lit(6)))
    number = F.coalesce(F.trim(F.get(F.filter("args", lambda a: ~a.rlike("^[^=|{}]+=")), F.lit(0))), F.lit(""))
    heading = F.when((F.col("zone") == "body") & F.col("name").isin(*HEADINGS), F.array_join("args", "|").rlike("תוספת|לוח|טופס"))
    base = (
        F.when(F.col("zone") == "contents", "contents")
        .when(F.col("zone") == "table", "raw_block")
        .when((F.col("zone") == "box") | name.isin(*BOXES, BOX_END), "box")
        .when(name == TITLE, "title")
        .when(name.isin(SECTION, STARRED), "section")
        .when(name.rlike(CONTENT), "content")
        .when(name.isin(*HEADINGS), "heading")
        .when(name.isin(*BENIGN), "skipped")
        .when((name != "") & (F.col("n") > 1), "raw_block")
        .when(F.col("text").startswith("{{"), F.when(name == "", "unclosed").otherwise("unknown"))
        .when(F.col("text").rlike(r"^\[\[קטגוריה:|(?i)^<includeonly>.*קטגוריה.*</includeonly>$"), "category")
        .when(F.col("text").rlike("^[.,;:]$"), "punctuation")
        .otherwise("continuation")
    )
    near = rows.withColumns({"__base": base, "__number": number, "__next": F.lead(name).over(doc), "__rest": F.lead("rest").over(doc), "__schedule": F.coalesce(F.last(heading, ignorenulls=True).over(doc), F.lit(False))})
    unanchored = F.when(~F.col("__schedule") & F.col("__next").isin("ח:תת", "ח:תתת"), "subsection").otherwise("unknown")
    told = F.when(value.rlike(LIST_WORDS), "list_item").when(value.rlike(r"^סעיף\s+[^\s.]+\."), F.when(number != "", "ambiguous").otherwise("subsection")).when(value.startswith("סעיף"), "section").otherwise("unknown")
    use = F.when(F.col("__base") == "section", F.when(name == SECTION, "section").when(anchor.isNull(), unanchored).otherwise(told))
    ahead = F.when(F.col("__next").rlike(CONTENT), F.nullif("__rest", F.lit("")))
    own = F.when(F.col("__base") == "section", F.when(F.col("__number") != "", F.concat(F.lit("n-"), "__number")).when(ahead.isNotNull(), F.concat(F.lit("c-"), F.substr(F.sha2(ahead, 256), F.lit(1), F.lit(8)))).otherwise(F.concat(F.lit("p-"), F.col("place").cast("string"))))
    out = near.withColumns({"kind": F.col("__base"), "use": use, "__own": own, "number": F.when(F.col("__base") == "section", F.col("__number"))})
    again = F.when(F.col("__own").isNotNull(), F.row_number().over(Window.partitionBy("doc_id", "__own").orderBy("place")))
    out = out.withColumn("id", F.when(again > 1, F.concat("__own", F.lit("~"), again.cast("string"))).otherwise(F.col("__own")))
    return out.select("doc_id", "place", "n", "text", "zone", "name", "rest", "kind", "use", "number", "id")


def conservation(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """What got lost between documents (doc_id, body) and classified rows: (doc_id, problem, place, detail), place null where
    a count is off. The lines are read afresh, by another way than the rows: calls by the running balance of braces."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("place", "line"))
    braces = lambda c: F.regexp_count(c, F.lit(r"\{\{")) - F.regexp_count(c, F.lit(r"\}\}"))
    running = F.sum(braces(F.col("line"))).over(Window.partitionBy("doc_id").orderBy("place"))
    lines = lines.withColumn("after", running).withColumn("before", F.col("after") - braces(F.col("line"))).where(F.trim("line") != "")
    covered = rows.select("doc_id", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("place"))
    lost = lines.join(covered, ["doc_id", "place"], "left_anti").select("doc_id", F.lit("line lost").alias("problem"), "place", F.trim("line").alias("detail"))

    name = F.regexp_extract("line", r"^\s*\{\{([^|}]+)", 1)
    opens = (F.col("before") == 0) & (name != "")
    known = name.isin(TITLE, SECTION, STARRED, *HEADINGS, *BOXES, BOX_END, *BENIGN) | name.rlike(CONTENT)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    raw = lines.groupBy("doc_id").agg(count(opens & name.isin(SECTION, STARRED)).alias("sections"), count(opens & ~known & (F.col("after") > 0)).alias("blocks"))
    hidden = F.when(F.col("zone").isin("contents", "table", "box"), F.regexp_count("text", F.lit(r"(?m)^\s*\{\{ח:סעיף\*?\s*[|}]"))).otherwise(0)
    kept = rows.groupBy("doc_id").agg((count(F.col("use").isNotNull()) + F.sum(hidden)).alias("kept_sections"), count((F.col("kind") == "raw_block") & F.col("name").isNotNull()).alias("kept_blocks"))
    both = raw.join(kept, "doc_id", "left").na.fill(0, ["kept_sections", "kept_blocks"])
    off = both.select("doc_id", F.inline(F.filter(F.array(
        F.struct(F.lit("section count").alias("problem"), F.col("sections").alias("a"), F.col("kept_sections").alias("b")),
        F.struct(F.lit("merged blocks").alias("problem"), F.col("blocks").alias("a"), F.least("kept_blocks", "blocks").alias("b")),
    ), lambda x: x["a"] != x["b"])))
    off = off.select("doc_id", "problem", F.lit(None).cast("int").alias("place"), F.concat(F.col("a").cast("string"), F.lit(" against "), F.col("b").cast("string")).alias("detail"))
    unknown = rows.where("kind IN ('unknown', 'unclosed')").select("doc_id", F.concat(F.col("kind"), F.lit(" template")).alias("problem"), "place", F.coalesce("name", "text").alias("detail"))
    ambiguous = rows.where("use = 'ambiguous'").select("doc_id", F.lit("ambiguous section").alias("problem"), "place", F.col("text").alias("detail"))
    return lost.unionByName(off).unionByName(unknown).unionByName(ambiguous)


def readable(text: Column) -> Column:
    """Inline markup away: images named, struck text gone, raised and lowered digits as characters, breaks as lines."""
    out = F.regexp_replace(text, r"(?i)\[\[\s*(?:Image|File|קובץ|תמונה)\s*:\s*([^|\]]+?)(?:\.(?:png|jpe?g|gif|svg|tiff?))?\s*(?:\|[^\]]*|\s+link=[^\]]*)?\]\]", "[תמונה: $1]")
    out = F.regexp_replace(out, r"(?is)\s<(s|strike|del)\b[^>]*>(?:(?!</\1\s*>).)*</\1\s*>(?=[\s.,;:)]|$)", "")
    out = F.regexp_replace(out, r"(?is)<(s|strike|del)\b[^>]*>.*?</\1\s*>", "")
    for tag, (plain, raised) in (("sup", SUPERSCRIPTS), ("sub", SUBSCRIPTS)):
        found = F.array_distinct(F.regexp_extract_all(out, F.lit(rf"(?is)(<{tag}\b[^>]*>.*?</{tag}\s*>)"), F.lit(1)))
        inner = lambda x: F.regexp_replace(x, r"^<[^>]*>|<[^<]*$", "")
        chars = "[" + re.escape(plain).replace("]", r"\]") + "]+"
        said = lambda x: F.when(inner(x).rlike(f"^{chars}$"), F.translate(inner(x), plain, raised)).otherwise(inner(x))
        out = F.aggregate(found, out, lambda acc, x: F.replace(acc, x, said(x)))
    out = F.regexp_replace(out, r"(?i)</?(?:wbr|nowiki)\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?i)<br\b[^>]*>", "\n")
    return F.regexp_replace(out, r"(?i)</?(?:span|div|i|u|b|small|big|font|center|em|strong)\b[^>]*>", "")


def template_names(text: Column) -> Column:
    """Names of the calls that a text still has, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\{\{([^|}]+)"), F.lit(1)), lambda x: F.trim(x))
