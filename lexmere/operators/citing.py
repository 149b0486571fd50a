"""Which sections of the amended law a bill names, and the labels that new units get in the gaps of a numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.functions.numbering import SUFFIXES, next_appended, section_key, suffix_ordinal
from lexmere.plans.registry import Tables, query

# Nouns of laws, words that open an instruction behind a law's name, the law that was named first, words
# before a section that an instruction is aimed at, other laws behind a section, and words of repeal and of addition.
LAW_NOUNS = ("חוק", "פקודת", "פקודה")
INSTRUCTIONS = ("אחרי", "לפני", "במקום", "בסעיף", "סעיף", "בתוספת", "בהגדרה", "בהגדרות", "בכותרת", "בפסקה", "בפרט", "בסופו", "בסופה", "בטל", "בטלה", "יבוא", "בחלק", "בפרק", "בסימן", "ברישה")
CALLED, MAIN = "(להלן", ("העיקרי", "העיקרית")
AIMS, SECTIONS = ("אחרי", "לפני", "במקום"), ("סעיף", "סעיפים")
# What both words of sections begin with, and how many words of a clause tell what it aims at.
SECTION_STEM, OPENING = "סעי", 5
TO_LAWS = ("לחוק", "לפקודת", "לפקודה")
REPEALED, ADDED = ("בטלים", "בטלה", "בטל"), "הוספ"
#: marks of this module within texts: between the numbers of a list, before a word of repeal, between clauses.
LISTED, GONE, CUT = "\u0002", "\u0004", "\u0001"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What then makes of a value that is computed once for a row, however often then uses it, also within lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _at(words: Column, i: int) -> Column:
    return F.coalesce(F.get(words, F.lit(i)), F.lit(""))


def _letters(word: Column) -> Column:
    return F.regexp_extract(word, "^[א-ת]*", 0)


def amended_law(text: Column) -> Column:
    """The name of the law that an instruction opens with, as written; empty for texts that open otherwise."""
    body = F.substr(F.ltrim(text), F.lit(2))
    first = F.translate(F.regexp_extract(text, r"(\S+)", 1), "־", "-")
    opens = F.regexp_extract(first, "^[א-ת]+(-יסוד)?", 0).isin(*[f"ב{n}" for n in LAW_NOUNS], "בחוק-יסוד")
    plain = F.get(F.split(F.substring_index(body, CALLED, 1), r"\s[–־-](\s|$)"), F.lit(0))
    stop = lambda parts: F.array_position(F.transform(parts, lambda p, i: (i > 0) & _letters(F.ltrim(p)).isin(*INSTRUCTIONS)), True).cast("int")
    name = _once(F.split(plain, ","), lambda parts: _once(stop(parts), lambda k: F.array_join(F.when(k > 0, F.slice(parts, 1, F.greatest(k - 1, F.lit(0)))).otherwise(parts), ",")))
    return F.when(opens, F.trim(F.rtrim(F.trim(name), F.lit(",")))).otherwise("")


def points_to_main(text: Column) -> Column:
    """Whether a text speaks of the law that was named first."""

    def points(w: Column) -> Column:
        opens = F.regexp_replace(_at(w, 0), "^[בל]", "").isin("חוק", "פקודה") & _at(w, 1).isin(*MAIN)
        behind = F.exists(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: (F.get(w, i).endswith("לחוק") | F.get(w, i).endswith("לפקודה")) & F.get(w, i + 1).isin(*MAIN))
        return opens | F.coalesce(behind, F.lit(False)) | (_at(w, 0) == "בפקודה")

    may = F.contains(text, F.lit(MAIN[0])) | F.contains(text, F.lit("בפקודה"))
    return F.when(may, _once(F.transform(_words(text), _letters), points)).otherwise(F.lit(False))


def _lists(text: Column) -> Column:
    """Lists of numbers drawn together, and brackets between a number and a law dropped."""
    drawn = F.regexp_replace(text, r"(?<=[0-9א-ת׳'\"])(?:\s*,\s*|\s+ו[־-]?\s*)(?=[0-9])", LISTED)
    return F.regexp_replace(drawn, rf"(?<=[0-9א-ת])\s*(?:\([^)]*\)\s*)+(?=(?:{'|'.join(TO_LAWS)})\s)", " ")


def _numbers(listed: Column) -> Column:
    """The numbers of a list up to the first that is none."""
    read = F.transform(F.split(listed, LISTED), lambda x: F.rtrim(F.regexp_extract(x, "^[0-9][0-9א-ת׳'\"]*", 0), F.lit("\"'׳")))
    gap = lambda xs: F.array_position(xs, "").cast("int")
    return _once(read, lambda xs: F.when(gap(xs) > 0, F.slice(xs, 1, F.greatest(gap(xs) - 1, F.lit(0)))).otherwise(xs))


def _aimed(w: Column, listed: int) -> Column:
    """The numbers in a clause's words from a place on, unless a single one belongs to another law."""
    other = _at(w, listed + 1).isin(*TO_LAWS) & ~_letters(_at(w, listed + 2)).isin(*MAIN)
    return _once(_numbers(_at(w, listed)), lambda numbers: F.when((F.size(numbers) == 1) & other, F.array().cast("array<string>")).otherwise(numbers))


def cited_numbers(text: Column, heading: Column) -> Column:
    """The sections that a line aims at, in order: in its heading unless that adds them; at the start of a clause behind
    in, after, before or instead of; and those that it repeals. Mentions within a clause don't count."""
    none = F.array().cast("array<string>")
    gone = F.regexp_replace(_lists(F.coalesce(text, F.lit(""))), rf"\s*[–־-]\s*(?={'|'.join(REPEALED)})", f" {GONE}")
    clauses = F.split(F.regexp_replace(F.translate(gone, ",;:.)]", CUT * 6), r"\s[–־-]", CUT), CUT)
    aims = lambda w: F.when(_at(w, 0).isin(*[f"ב{s}" for s in SECTIONS]), _aimed(w, 1)).when(_at(w, 0).isin(*AIMS) & _at(w, 1).isin(*SECTIONS), _aimed(w, 2)).otherwise(none)
    repeals = lambda w: F.when(_at(w, 0).isin(*SECTIONS) & _at(w, 2).startswith(GONE) & ~F.contains(_at(w, 1), F.lit(LISTED)), _numbers(_at(w, 1))).otherwise(none)
    follow = lambda h: F.transform(h, lambda x, i: F.when(x.endswith(SECTIONS[0]) | x.endswith(SECTIONS[1]), _numbers(F.coalesce(F.get(h, i + 1), F.lit("")))).otherwise(none))
    headed = lambda h: F.when(F.exists(h, lambda x: x.startswith(ADDED)), none).otherwise(F.flatten(follow(h)))
    told = lambda words: F.concat(F.flatten(F.transform(words, aims)), F.flatten(F.transform(words, repeals)))
    speaks = lambda x: F.contains(x, F.lit(SECTION_STEM))
    openings = F.transform(F.filter(clauses, speaks), lambda c: F.filter(F.split(c, r"\s+", OPENING + 2), lambda w: w != ""))
    in_heading = F.when(speaks(heading), _once(_words(_lists(heading)), headed)).otherwise(none)
    every = F.concat(in_heading, F.when(speaks(text), _once(openings, told)).otherwise(none))
    return F.filter(every, lambda x: x != "")


def cited_sections_of(lines: DataFrame, order: list[str]) -> DataFrame:
    """lines (bill_id, depth, number, heading, text, and the columns of order): a row for each section of the main law that
    a bill names (bill_id, law, section, place from 1).

    The law named first is the main one. A numbered line of depth 0 sets what its own and the lines below it are about:
    the law that it opens with, the main law if it points there, else none. Only what is about the main law counts, and a
    section once, where it is named first. Null texts, headings and numbers count as empty. Bills without a law named have
    no rows. The running window reads each bill's lines in order and keeps two values.
    """
    w = Window.partitionBy("bill_id").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce("text", F.lit(""))
    section = (F.col("depth") == 0) & (F.coalesce("number", F.lit("")) != "")
    rows = lines.select("bill_id", *order, section.alias("__section"), F.when(section, F.nullif(amended_law(text), F.lit(""))).alias("__law"), points_to_main(text).alias("__main"), cited_numbers(text, F.col("heading")).alias("__cited"))
    rows = rows.withColumn("law", F.first("__law", ignorenulls=True).over(so_far))
    about = F.when(F.col("__section"), F.coalesce(F.col("__law") == F.col("law"), F.col("__main") & F.col("law").isNotNull()))
    rows = rows.withColumn("__about", F.last(about, ignorenulls=True).over(so_far)).withColumn("__line", F.row_number().over(w))
    named = rows.where("__about").select("bill_id", "law", "__line", F.posexplode("__cited").alias("__pos", "section"))
    first = named.groupBy("bill_id", "law", "section").agg(F.min(F.struct("__line", "__pos")).alias("__first"))
    return first.select("bill_id", "law", "section", F.row_number().over(Window.partitionBy("bill_id").orderBy("__first")).alias("place"))


def insertion_labels(units: DataFrame, group: list[str], place: str | None = None) -> DataFrame:
    """units (the columns of group, number): for each distinct number the label of a new unit right behind it (label).

    Behind the last unit of a group, by ``place`` or else in legal order, the numbering goes on; elsewhere the first free
    label that adds a segment: a letter to digits, a number to letters. Numbers in brackets give labels in brackets.
    Malformed and null numbers give null, as do gaps whose letters are used up and rows with a null in a group column. Free labels are found by an anti-join of
    the labels one further than those there are, so that no group is collected. Other columns don't count.
    """
    bare = F.regexp_replace(F.trim("number"), r"^\((.*)\)$", "$1")
    rows = units.select(*group, "number", *([place] if place else []), bare.alias("__bare"))
    good = F.col("__bare").rlike(r"^(\d+|[א-ת]+)+$")
    known = rows.where(good)
    tail = F.regexp_extract("__bare", r"(\d+|[א-ת]+)$", 1)
    head = F.substr("__bare", F.lit(1), F.length("__bare") - F.length(tail))
    ordinal = F.when(tail.rlike(r"^\d"), tail.try_cast("int")).otherwise(suffix_ordinal(tail).cast("int"))
    there = known.select(*group, head.alias("__head"), ordinal.alias("__ordinal")).where("__head <> '' and __ordinal is not null").distinct()
    heads = known.select(*group, F.col("__bare").alias("__head")).distinct()
    further = heads.withColumn("__ordinal", F.lit(1)).unionByName(there.withColumn("__ordinal", F.col("__ordinal") + 1)).distinct()
    free = further.join(there, [*group, "__head", "__ordinal"], "left_anti").groupBy(*group, "__head").agg(F.min("__ordinal").alias("__free"))
    key = F.col(place) if place else section_key(F.col("__bare"))
    last = known.groupBy(*group).agg(F.max_by("__bare", key).alias("__last"))
    out = rows.select(*group, "number", "__bare", good.alias("__good")).distinct()
    out = out.join(last, group, "left").join(free.withColumnRenamed("__head", "__bare"), [*group, "__bare"], "left")
    letters = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), F.col("__free") - 1)
    inserted = F.concat("__bare", F.when(F.col("__bare").rlike(r"\d$"), letters).otherwise(F.col("__free").cast("string")))
    label = F.when(F.col("__good"), F.when(F.col("__bare") == F.col("__last"), next_appended(F.col("__bare"))).otherwise(inserted))
    return out.select(*group, "number", F.when(F.col("number").startswith("("), F.concat(F.lit("("), label, F.lit(")"))).otherwise(label).alias("label"))


def _line(rows: DataFrame) -> DataFrame:
    """Lines of bills in five forms: two laws that sections open with, a section of the bill itself, the main law, and a
    line below a section."""
    s = lambda c: c.cast("string")
    n, m, k, form = s(F.col("l_suppkey") % 50 + 1), s(F.col("l_linenumber")), s(F.col("l_partkey") % 97 + 1), F.col("l_partkey") % 5
    text = (
        F.when(form == 0, F.concat(F.lit('בחוק הבנקאות, התשמ"א–1981, בסעיף '), n, F.lit(" –")))
        .when(form == 1, F.concat(F.lit("בפקודת התעבורה, אחרי סעיף "), n, F.lit(" יבוא:")))
        .when(form == 2, F.concat(F.lit("תחילתו של חוק זה, בסעיף "), n, F.lit(" ביום פרסומו.")))
        .when(form == 3, F.concat(F.lit("בסעיפים "), n, F.lit(", "), m, F.lit("א ו-"), k, F.lit(" לחוק העיקרי, כאמור בסעיף 900")))
        .otherwise(F.concat(F.lit("בסעיף "), n, F.lit('(ב), במקום "א" יבוא "ב"; סעיף '), m, F.lit(" – בטל; בסעיף 901(א) לחוק הירושה")))
    )
    heading = F.when(form == 0, F.concat(F.lit("תיקון סעיף "), k)).when(form == 1, F.lit("הוספת סעיף 902"))
    return rows.select(F.col("l_orderkey").alias("bill_id"), "l_linenumber", "l_partkey", "l_suppkey", F.when(form == 4, 1).otherwise(0).alias("depth"), F.when(form != 4, m).alias("number"), heading.alias("heading"), text.alias("text"))


@query("""
WITH l AS (SELECT l_orderkey AS bill_id, l_linenumber AS o, l_partkey AS p, l_suppkey AS s, l_partkey % 5 AS form, (l_suppkey % 50 + 1)::VARCHAR AS n, l_linenumber::VARCHAR AS m, (l_partkey % 97 + 1)::VARCHAR AS k,
  CASE l_partkey % 5 WHEN 0 THEN 'חוק הבנקאות, התשמ"א–1981' WHEN 1 THEN 'פקודת התעבורה' END AS name FROM lineitem),
a AS (SELECT *, first_value(name IGNORE NULLS) OVER w AS law, row_number() OVER w AS line FROM l WINDOW w AS (PARTITION BY bill_id ORDER BY o, p, s ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, last_value(CASE WHEN form IN (0, 1) THEN name = law WHEN form = 2 THEN false WHEN form = 3 THEN law IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY bill_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS about FROM a),
c AS (SELECT bill_id, law, line, unnest(CASE form WHEN 0 THEN [k, n] WHEN 1 THEN [n] WHEN 3 THEN [n, m || 'א', k] WHEN 4 THEN [n, m] ELSE [] END) AS section,
  unnest(CASE form WHEN 0 THEN [0, 1] WHEN 1 THEN [0] WHEN 3 THEN [0, 1, 2] WHEN 4 THEN [0, 1] ELSE [] END) AS pos FROM b WHERE about),
d AS (SELECT bill_id, law, section, min(line * 10 + pos) AS first FROM c GROUP BY ALL)
SELECT bill_id, law, section, row_number() OVER (PARTITION BY bill_id ORDER BY first) AS place FROM d""")
def cited_sections(t: Tables) -> DataFrame:
    """Sections of the law that each order, taken as a bill, amends."""
    return cited_sections_of(_line(t.lineitem), ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""
WITH p AS (SELECT DISTINCT p_brand AS law_id, p_size AS b, p_partkey % 31 % 6 AS l, CASE WHEN p_partkey % 31 % 6 > 0 AND p_partkey % 4 = 0 THEN p_partkey % 3 + 1 ELSE 0 END AS d FROM part),
x AS (SELECT *, b::VARCHAR || CASE WHEN l = 0 THEN '' ELSE @S[l] END || CASE WHEN d = 0 THEN '' ELSE d::VARCHAR END AS number, row_number() OVER (PARTITION BY law_id ORDER BY b DESC, l DESC, d DESC) AS back FROM p),
f AS (SELECT law_id, b, l, d, (SELECT min(i) FROM range(1, 9) r(i) WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.law_id = x.law_id AND y.b = x.b AND CASE WHEN x.l = 0 THEN y.l = i AND y.d = 0 WHEN x.d = 0 THEN y.l = x.l AND y.d = i ELSE false END)) AS free FROM x)
SELECT law_id, number, CASE WHEN back = 1 THEN CASE WHEN l = 0 THEN (b + 1)::VARCHAR WHEN d = 0 THEN b::VARCHAR || @S[l + 1] ELSE b::VARCHAR || @S[l] || (d + 1) END
  WHEN l > 0 AND d = 0 THEN number || free ELSE number || @S[free] END AS label
FROM x JOIN f USING (law_id, b, l, d)""".replace("@S", str(SUFFIXES)))
def insertion_points(t: Tables) -> DataFrame:
    """The label of a new section behind each section of each brand, taken as a law."""
    n = F.col("p_partkey") % 31 % 6
    letter = F.when(n == 0, "").otherwise(F.get(F.array(*[F.lit(s) for s in SUFFIXES]), n.cast("int") - 1))
    last = F.when((n > 0) & (F.col("p_partkey") % 4 == 0), (F.col("p_partkey") % 3 + 1).cast("string")).otherwise("")
    return insertion_labels(t.part.select(F.col("p_brand").alias("law_id"), F.concat(F.col("p_size").cast("string"), letter, last).alias("number")), ["law_id"])
