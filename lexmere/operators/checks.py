"""Checks of draft bills, by number: each bill has a row for every check, with a status that says if it was made at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.functions.numbering import section_key
from lexmere.functions.shared import stage
from lexmere.functions.text import squeeze
from lexmere.operators.citing import cited_sections_of
from lexmere.plans.registry import Tables, query

# Words of amendment that open a heading and what may follow them; headings that name a section of their own;
# words of sections at the end of a bill; titles of amending bills; the name for the main law; the year's first letters.
ACTIONS = ("תיקון", "החלפת", "ביטול", "הוספת")
SECTION, SECTIONS = "סעיף", "סעיפים"
UNITS = ("פרק", "סימן", "תוספת", "סעיפים", "הפרק", "הסימן", "התוספת", "הסעיפים")
COMPARISON = ("לוח השוואה", "הלוח השוואה")
LAWS = ("חוק", "פקודת", "פקודה")
ORDERS = ("תקנות", "צו")
OWN_HEADINGS = ("תחילה", "תחילתו", "תחילתה", "תחולה", "הוראת מעבר", "הוראות מעבר", "ביצוע", "תקנות ראשונות", "שמירת דינים", "פרסום", "מטרה", "מטרות", "הגדרות")
TAIL_WORDS = ("תחילה", "תחולה", "הוראת מעבר", "הוראות מעבר", "תקנות ראשונות", "צו ראשון", "ביצוע", "דיווח לכנסת", "דוח לכנסת", "דין וחשבון")
BILL, AMENDS, MARKED = "הצעת חוק ", "הצעת חוק לתיקון ", (" (תיקון – ", " (תיקוני חקיקה")
NUMBERED = r" \(תיקון מס['׳] ?[0-9]"
MAIN_LAW, MAIN_MENTION = "להלן–החוק העיקרי", "החוק העיקרי"
MAIN_LOOSE = r"להלן\s*[–-]?\s*ה?חוק\s+ה?עיקרי"
PLAIN_DASH_YEAR = "ת[קרש][א-ת\"״׳']{0,4}-[0-9]{4}"
BEHIND_TERM = ('אחרי ההגדרה "', '" יבוא:')
LINE_WORDS = ("שורה", "שורות")
PASSED, FAILED, WARNING, SKIPPED = "passed", "failed", "warning", "not checked"
NAMES = {1: "cited sections exist", 2: "footnotes have references", 3: "main law named once", 4: "headings", 5: "quotation marks", 6: "dashes in years", 7: "title", 8: "title year", 9: "sections in order", 11: "terms in order", 12: "tail last"}
AMENDING_ONLY = (1, 4, 7)


def _word(words: Column, i: int) -> Column:
    return F.coalesce(F.regexp_extract(F.get(words, F.lit(i)), "^[א-ת]*", 0), F.lit(""))


def _acts_on(heading: Column, nouns: tuple[str, ...]) -> Column:
    w = F.split(heading, " ")
    return F.coalesce(F.get(w, F.lit(0)).isin(*ACTIONS) & _word(w, 1).isin(*nouns), F.lit(False))


def heading_is_known(heading: Column) -> Column:
    """Headings of amendments name a section, another unit or a law; others are known by their first words."""
    w = F.split(heading, " ")
    one, two = _word(w, 0), F.concat_ws(" ", _word(w, 0), _word(w, 1))
    section = F.get(w, F.lit(0)).isin(*ACTIONS) & (F.get(w, F.lit(1)) == SECTION) & (F.size(w) > 2) & ~heading.rlike("[()]")
    table = F.get(w, F.lit(0)).isin(*ACTIONS) & F.concat_ws(" ", _word(w, 1), _word(w, 2)).isin(*COMPARISON)
    return F.coalesce(section, F.lit(False)) | _acts_on(heading, UNITS + LAWS) | F.coalesce(table, F.lit(False)) | one.isin(*OWN_HEADINGS) | two.isin(*OWN_HEADINGS)


def is_tail(heading: Column) -> Column:
    """Sections that stand at the end: those that hold one of the words, and amendments of other laws."""
    return reduce(Column.__or__, [F.contains(heading, F.lit(w)) for w in TAIL_WORDS]) | _acts_on(heading, LAWS + ORDERS)


def title_amends(title: Column) -> Column:
    """Titles of amending bills: a bracket with what it is, or the words for an amendment, and the year behind a comma."""
    year = F.substring_index(title, ", ", -1)
    head = F.substr(title, F.lit(1), F.length(title) - F.length(year) - 2)
    dated = F.contains(title, F.lit(", ")) & year.startswith("התש") & year.rlike("^[^–-]{4,}[–-][0-9]{4}$")
    named = lambda at: at > len(BILL)  # noqa: E731  a name stands before the bracket
    bracket = named(F.instr(head, MARKED[0])) & (F.instr(head, MARKED[0]) + len(MARKED[0]) < F.length(head)) | named(F.instr(head, MARKED[1])) | named(F.regexp_instr(head, F.lit(NUMBERED)))
    return dated & ((head.startswith(BILL) & bracket & head.endswith(")")) | (head.startswith(AMENDS) & (F.length(head) > len(AMENDS))))


def _term(text: Column) -> tuple[Column, Column]:
    """The term behind which definitions come, and the term that a line defines; null where a text isn't of that form."""
    start, end = BEHIND_TERM
    inner = F.substr(text, F.lit(len(start) + 1), F.length(text) - len(start) - len(end))
    anchor = F.when(text.startswith(start) & text.endswith(end) & (inner != "") & ~F.contains(inner, F.lit('"')), inner)
    parts = F.split(text, '"')
    return anchor, F.when(text.startswith('"') & (F.size(parts) > 2) & (F.get(parts, F.lit(1)) != ""), F.get(parts, F.lit(1)))


def _alphabetical(term: Column) -> Column:
    return F.when(term.startswith("ה") & (F.length(term) > 1), F.substr(term, F.lit(2))).otherwise(term)


def _as_flag(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _met(here: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Whether each bill's key is in either table (here, there) and whether there has the bill (known: on a row of its own
    if its key is null): by one aggregation, so that neither table can be sent to all tasks."""
    side = lambda df, x, y, z: df.select("bill_id", key, x.alias("here"), y.alias("there"), z.alias("known"))
    no, yes = F.lit(False), F.lit(True)
    both = side(here, yes, no, no).unionByName(side(there, no, F.col(key).isNotNull(), yes))
    return both.groupBy("bill_id", key).agg(*[F.max(c).alias(c) for c in ("here", "there", "known")])


def draft_findings(bills: DataFrame, lines: DataFrame, refs: DataFrame, sections: DataFrame) -> DataFrame:
    """bills (bill_id, kind, title, submitted), lines (bill_id, place, depth, number, heading, text, quoted, footnotes), refs
    (bill_id, key), sections (bill_id, section: those of the law that a bill amends): a row for each bill and check
    (bill_id, number, check, status, n_bad).

    Checks 1, 4 and 7 are made of amending bills only; a check that has nothing to go by is not checked rather than passed.
    Quoted lines don't count for the dash in years. Null texts, headings and titles count as empty; lines without a bill
    and bills without an id have no rows; repeated bills are one; bills without lines pass what lines could break.
    Aggregations and windows of neighbours, and one join of what they give, sorted; no bill is collected and nothing that
    grows with the bills goes through the driver.
    """
    heading, text = squeeze(F.coalesce("heading", F.lit(""))), F.coalesce("text", F.lit(""))
    base = lines.select("bill_id", "place", "depth", "number", heading.alias("heading"), text.alias("text"), F.coalesce("quoted", F.lit(False)).alias("quoted"), "footnotes")
    w = Window.partitionBy("bill_id").orderBy("place")
    headed = F.col("heading") != ""
    anchor, term = _term(F.col("text"))
    rows = base.withColumn("term", F.lead(term).over(w)).withColumn("anchor", anchor)
    plain = F.regexp_replace("text", r"\s*–\s*", "–")
    defines, mentions, tail = F.contains(plain, F.lit(MAIN_LAW)), F.contains(F.col("text"), F.lit(MAIN_MENTION)), is_tail(F.col("heading"))
    per = rows.groupBy("bill_id").agg(
        _as_flag(headed & ~heading_is_known(F.col("heading"))).alias("b4"),
        _as_flag(F.contains(F.concat("text", "heading"), F.lit("״"))).alias("b5"),
        _as_flag(~F.col("quoted") & (F.col("text").rlike(PLAIN_DASH_YEAR) | F.col("heading").rlike(PLAIN_DASH_YEAR))).alias("b6"),
        _as_flag(_alphabetical(F.col("term")) < _alphabetical(F.col("anchor"))).alias("b11"),
        _as_flag(_acts_on(F.col("heading"), (SECTION, SECTIONS, "פרק", "סימן", "תוספת", "התוספת"))).alias("principal"),
        _as_flag(defines).alias("defined"),
        F.min(F.when(defines, F.col("place"))).alias("defined_at"),
        _as_flag(F.col("text").rlike(MAIN_LOOSE)).alias("loose"),
        F.min(F.when(mentions, F.col("place"))).alias("mentioned_at"),
        F.coalesce(F.max(F.when(headed & ~tail, F.col("place"))) > F.min(F.when(headed & tail, F.col("place"))), F.lit(False)).cast("long").alias("b12"),
    )
    # 9: the sections that headings end with, each where it comes first
    pieces = F.split("heading", " ")
    named = rows.where(F.size(pieces) > 1).select("bill_id", "place", F.get(pieces, F.size(pieces) - 2).alias("noun"), F.get(pieces, F.size(pieces) - 1).alias("section"))
    first = named.where(F.col("noun").endswith(SECTION)).groupBy("bill_id", "section").agg(F.min("place").alias("place")).withColumn("key", section_key(F.col("section")))
    order = first.withColumn("above", F.lag("key").over(w)).groupBy("bill_id").agg(_as_flag(F.col("key").isNull()).alias("malformed"), _as_flag(F.col("above") > F.col("key")).alias("b9"))
    # 2: keys that no reference has
    used = base.select("bill_id", F.explode("footnotes").alias("key"))
    unknown = _met(used, refs, "key").groupBy("bill_id").agg(_as_flag(F.col("here") & ~F.col("there")).alias("b2"))
    # 1: sections that the amended law doesn't have
    cited = cited_sections_of(base, ["place"]).select("bill_id", "section")
    missing = _met(cited, sections, "section").groupBy("bill_id").agg(_as_flag(F.col("here") & ~F.col("there")).alias("b1"), (F.max("here") & F.max("known")).alias("cites"))
    title = squeeze(F.coalesce("title", F.lit("")))
    year = F.when(F.regexp_like("title", F.lit("–[0-9]{4}$")), F.right("title", F.lit(4)))
    given = F.nullif(F.regexp_extract("submitted", "[0-9]{4}", 0), F.lit(""))
    every = bills.where("bill_id is not null").select("bill_id", "kind", title.alias("title"), "submitted").dropDuplicates(["bill_id"])
    # Five joins would be as many tables of all bills that may pass through the driver on their way to all tasks.
    parts = [per, order, unknown, missing]
    kept = [c for part in parts for c in part.columns if c != "bill_id"]
    of_bill = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).groupBy("bill_id").agg(*[F.max(c).alias(c) for c in kept])
    every = every.join(of_bill.hint("merge"), "bill_id", "left")
    every = stage(every, "judged")  # eleven findings a row read it: no plan holds what they go by
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    judged = lambda c, bad=FAILED: F.when(n(F.col(c)) > 0, bad).otherwise(PASSED)
    principal, defined = n(F.col("principal")), n(F.col("defined"))
    early = F.coalesce(F.col("mentioned_at") < F.col("defined_at"), F.lit(False))
    wrong3 = ((n(F.col("loose")) > 0) & (defined == 0)) | ((principal == 1) & (defined > 0)) | ((principal > 1) & ((defined != 1) | early))
    status = {
        1: F.when(F.col("cites"), judged("b1")).otherwise(SKIPPED),
        2: judged("b2"),
        3: F.when(principal == 0, SKIPPED).when(wrong3, FAILED).otherwise(PASSED),
        4: judged("b4"), 5: judged("b5"), 6: judged("b6"),
        7: F.when(title_amends(F.col("title")), PASSED).otherwise(FAILED),
        8: F.when(given.isNull(), SKIPPED).when(F.coalesce(year == given, F.lit(False)), PASSED).otherwise(FAILED),
        9: F.when(n(F.col("malformed")) > 0, SKIPPED).otherwise(judged("b9")),
        11: judged("b11", WARNING), 12: judged("b12"),
    }
    counted = {1: n(F.col("b1")), 2: n(F.col("b2")), 4: n(F.col("b4")), 5: n(F.col("b5")), 6: n(F.col("b6")), 9: n(F.col("b9")), 11: n(F.col("b11")), 12: n(F.col("b12"))}

    def finding(k: int) -> Column:
        s = status[k]
        if k in AMENDING_ONLY:
            s = F.when(F.col("kind") == "amending", s).otherwise(SKIPPED)
        bad = F.when(s == SKIPPED, F.lit(None)).otherwise(counted.get(k, (s != PASSED).cast("long")))
        return F.struct(F.lit(k).alias("number"), F.lit(NAMES[k]).alias("check"), s.alias("status"), bad.cast("long").alias("n_bad"))

    return every.select("bill_id", F.explode(F.array(*[finding(k) for k in NAMES])).alias("f")).select("bill_id", "f.*")


def unanchored(explanations: DataFrame, findings: DataFrame) -> DataFrame:
    """explanations (id, text), findings (id, message): the explanations that point to lines which no message of their
    finding names (id, lines). Explanations that point to no line are never among them; null texts count as empty."""
    single = F.regexp_extract_all("text", F.lit(rf"{LINE_WORDS[0]}\s+([0-9]+)"), F.lit(1))
    several = F.regexp_extract_all("text", F.lit(rf"{LINE_WORDS[1]}\s+([0-9,\s ו-]+)"), F.lit(1))
    numbers = F.flatten(F.transform(F.concat(single, several), lambda x: F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1))))
    said = explanations.select("id", F.explode(F.transform(numbers, lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0")))).alias("line")).distinct()
    named = findings.select("id", F.explode(F.regexp_extract_all("message", F.lit("0*([0-9]+)"), F.lit(1))).alias("line")).distinct()
    return said.join(named, ["id", "line"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


TERMS = ("בנק", "הגבלה", "אגרה", "תאגיד")


def _pick(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


@query(f"""
WITH l AS (SELECT l_orderkey AS b, l_partkey % 7 AS f, l_suppkey % 50 + 1 AS n, l_linenumber, (l_linenumber % 5)::VARCHAR AS key, {list(TERMS)}[l_linenumber % 4 + 1] AS term,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS place FROM lineitem),
a AS (SELECT *, lead(CASE WHEN f = 5 THEN term END) OVER w AS next, first_value(CASE f WHEN 0 THEN 'a' WHEN 1 THEN 'b' END IGNORE NULLS) OVER (PARTITION BY b ORDER BY place ROWS UNBOUNDED PRECEDING) AS law FROM l WINDOW w AS (PARTITION BY b ORDER BY place)),
p AS (SELECT b, count(*) FILTER (f = 3) AS b4, count(*) FILTER (f = 4 AND CASE WHEN starts_with(next, 'ה') THEN substr(next, 2) ELSE next END < CASE WHEN starts_with(term, 'ה') THEN substr(term, 2) ELSE term END) AS b11,
  count(*) FILTER (f IN (0, 6)) AS principal, count(*) FILTER (f = 6) AS defined, CASE WHEN max(place) FILTER (f IN (0, 3, 6)) > min(place) FILTER (f IN (1, 2)) THEN 1 ELSE 0 END AS b12 FROM a GROUP BY 1),
s AS (SELECT b, n, f = 6 AS letter, min(place) AS place FROM l WHERE f IN (0, 6) GROUP BY ALL),
o AS (SELECT b, count(*) FILTER (above > n * 2 + letter::INT) AS b9 FROM (SELECT *, lag(n * 2 + letter::INT) OVER (PARTITION BY b ORDER BY place) AS above FROM s) GROUP BY 1),
k AS (SELECT b, count(*) AS b2 FROM (SELECT DISTINCT b, key FROM l WHERE (key::BIGINT + b) % 4 = 0) GROUP BY 1),
c AS (SELECT b, count(DISTINCT n) AS cites, count(DISTINCT n) FILTER (n > 40) AS b1 FROM a WHERE (f = 0 AND law = 'a') OR (f = 1 AND law = 'b') GROUP BY 1),
j AS (SELECT o_orderkey AS bill_id, o_orderkey % 4 < 2 AS amending, o_orderkey % 6 AS t, CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) END AS y, 1992 + o_orderkey % 7 AS ty, p.*, o.b9, k.b2, c.cites, c.b1, o_orderkey % 3 > 0 AS known
  FROM orders LEFT JOIN p ON p.b = o_orderkey LEFT JOIN o ON o.b = o_orderkey LEFT JOIN k ON k.b = o_orderkey LEFT JOIN c ON c.b = o_orderkey),
r AS (
  SELECT bill_id, 1 AS number, '{NAMES[1]}' AS "check", CASE WHEN NOT amending OR cites IS NULL OR NOT known THEN 'not checked' WHEN b1 > 0 THEN 'failed' ELSE 'passed' END AS status, coalesce(b1, 0) AS n_bad FROM j
  UNION ALL SELECT bill_id, 2, '{NAMES[2]}', CASE WHEN b2 > 0 THEN 'failed' ELSE 'passed' END, coalesce(b2, 0) FROM j
  UNION ALL SELECT bill_id, 3, '{NAMES[3]}', CASE WHEN coalesce(principal, 0) = 0 THEN 'not checked' WHEN (principal = 1 AND defined > 0) OR (principal > 1 AND defined <> 1) THEN 'failed' ELSE 'passed' END,
    CASE WHEN (principal = 1 AND defined > 0) OR (principal > 1 AND defined <> 1) THEN 1 ELSE 0 END FROM j
  UNION ALL SELECT bill_id, 4, '{NAMES[4]}', CASE WHEN NOT amending THEN 'not checked' WHEN b4 > 0 THEN 'failed' ELSE 'passed' END, coalesce(b4, 0) FROM j
  UNION ALL SELECT bill_id, 5, '{NAMES[5]}', CASE WHEN b4 > 0 THEN 'failed' ELSE 'passed' END, coalesce(b4, 0) FROM j
  UNION ALL SELECT bill_id, 6, '{NAMES[6]}', CASE WHEN b4 > 0 THEN 'failed' ELSE 'passed' END, coalesce(b4, 0) FROM j
  UNION ALL SELECT bill_id, 7, '{NAMES[7]}', CASE WHEN NOT amending THEN 'not checked' WHEN t < 4 THEN 'passed' ELSE 'failed' END, CASE WHEN t < 4 THEN 0 ELSE 1 END FROM j
  UNION ALL SELECT bill_id, 8, '{NAMES[8]}', CASE WHEN y IS NULL THEN 'not checked' WHEN y = ty AND t <> 5 THEN 'passed' ELSE 'failed' END, CASE WHEN y = ty AND t <> 5 THEN 0 ELSE 1 END FROM j
  UNION ALL SELECT bill_id, 9, '{NAMES[9]}', CASE WHEN b9 > 0 THEN 'failed' ELSE 'passed' END, coalesce(b9, 0) FROM j
  UNION ALL SELECT bill_id, 11, '{NAMES[11]}', CASE WHEN b11 > 0 THEN 'warning' ELSE 'passed' END, coalesce(b11, 0) FROM j
  UNION ALL SELECT bill_id, 12, '{NAMES[12]}', CASE WHEN b12 > 0 THEN 'failed' ELSE 'passed' END, coalesce(b12, 0) FROM j)
SELECT bill_id, number, "check", status, CASE WHEN status <> 'not checked' THEN n_bad::BIGINT END AS n_bad FROM r""")
def bill_checks(t: Tables) -> DataFrame:
    """Orders as bills of six titles and three kinds, their lines in seven forms."""
    s = lambda c: c.cast("string")
    f, n, term = F.col("l_partkey") % 7, s(F.col("l_suppkey") % 50 + 1), _pick(F.col("l_linenumber") % 4, TERMS)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber"))
    heading = F.when(f == 0, F.concat(F.lit("תיקון סעיף "), n)).when(f == 1, "תיקון  פקודת התעבורה").when(f == 2, "תחילה ותחולה").when(f == 3, "עניין אחר").when(f == 6, F.concat(F.lit("הוספת סעיף "), n, F.lit("א")))
    text = (
        F.when(f == 0, F.concat(F.lit('בחוק הבנקאות, התשמ"א–1981, בסעיף '), n, F.lit(" –")))
        .when(f == 1, F.concat(F.lit("בפקודת התעבורה, אחרי סעיף "), n, F.lit(" יבוא:")))
        .when(f == 2, "תחילתו של חוק זה ביום פרסומו")
        .when(f == 3, 'לפי התשמ"א-1981 וכן ״זה״')
        .when(f == 4, F.concat(F.lit(BEHIND_TERM[0]), term, F.lit(BEHIND_TERM[1])))
        .when(f == 5, F.concat(F.lit('"'), term, F.lit('" – כהגדרתו בחוק התשמ"א-1981')))
        .otherwise("יבוא (להלן – החוק העיקרי)")
    )
    number = F.when(~f.isin(4, 5), s(F.col("l_linenumber")))
    lines = t.lineitem.select(F.col("l_orderkey").alias("bill_id"), place.alias("place"), F.when(number.isNull(), 1).otherwise(0).alias("depth"), number.alias("number"), heading.alias("heading"), text.alias("text"), (f == 5).alias("quoted"), F.array(s(F.col("l_linenumber") % 5)).alias("footnotes"))
    k = F.col("o_orderkey")
    year = s(F.lit(1992) + k % 7)
    names = ("הצעת חוק א (תיקון – ב)", "הצעת חוק א (תיקון מס' 7)", "הצעת חוק א (תיקוני חקיקה)", "הצעת חוק לתיקון פקודת א", "הצעת חוק א")
    title = F.when(k % 6 == 5, "הצעת חוק בלי שנה").otherwise(F.concat(_pick(F.least(k % 6, F.lit(4)), names), F.lit(', התשנ"ב–'), year))
    bills = t.orders.select(k.alias("bill_id"), F.when(k % 4 < 2, "amending").when(k % 4 == 2, "new").otherwise("unknown").alias("kind"), title.alias("title"), F.when(k % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("submitted"))
    refs = t.orders.select(k.alias("bill_id"), F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda x: (x + k) % 4 != 0), s)).alias("key"))
    sections = t.orders.where("o_orderkey % 3 > 0").select(k.alias("bill_id"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), s)).alias("section"))
    return draft_findings(bills, lines, refs, sections)


@query("""
SELECT conv_id AS id, list_sort(list_distinct(list_filter(s, lambda x: NOT list_contains(m, x)))) AS lines FROM (
  SELECT a.conv_id, list_transform(regexp_extract_all(string_agg(a.text, ' '), '[0-9]+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')) AS s,
         list_transform(regexp_extract_all(coalesce((SELECT b.text FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = 0 LIMIT 1), ''), '[0-9]+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')) AS m
  FROM conversations a WHERE a.turn > 0 GROUP BY 1)
WHERE len(list_filter(s, lambda x: NOT list_contains(m, x))) > 0""")
def unanchored_explanations(t: Tables) -> DataFrame:
    """Numbers of later turns, taken as lines, that the first turn doesn't name."""
    lines = F.transform(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), lambda x: F.concat(F.lit(f"{LINE_WORDS[0]} "), x))
    said = t.conversations.where("turn > 0").select(F.col("conv_id").alias("id"), F.array_join(lines, " ").alias("text"))
    return unanchored(said, t.conversations.where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("message")))
