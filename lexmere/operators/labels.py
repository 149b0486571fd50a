"""Labels and references as readers know them, keys of templates, notes of sections, precedence of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.functions.text import sentences
from lexmere.plans.registry import Tables, query

# The letters of private, government and committee bills, words of references, openings of notes.
BILL_LETTERS = {"פרטית": "פ", "ממשלתית": "מ", "ועדה": "כ"}
SERIES, ISSUE, PAGE, SECTION = "פרסום", "מס' ", "עמ' ", "סעיף "
NOTE_OPENINGS = {"החל מ": "deferred", "הוראת שעה": "deferred", "ספרור שגוי": "numbering_error", "מספור כפול": "numbering_error", "פקע": "expired"}
PREFIXES = "ובלמכשה"


def bill_label(kind: Column, serial: Column, term: Column) -> Column:
    """Letter, number and term between slashes; without a term the first two; null without letter or number."""
    letter = F.create_map(*[F.lit(x) for pair in BILL_LETTERS.items() for x in pair])[kind]
    return F.when(letter.isNotNull() & (serial != ""), F.concat_ws("/", letter, serial, F.nullif(term, F.lit(""))))


def reference(series: Column, issue: Column, own_page: Column, first_page: Column) -> Column:
    """Series, issue and page; the page of the amendment itself goes before the page on which its bill begins."""
    page = F.coalesce(own_page, first_page)
    return F.concat_ws(", ", F.coalesce(F.nullif(series, F.lit("")), F.lit(SERIES)), F.concat(F.lit(ISSUE), F.nullif(issue, F.lit(0)).cast("string")), F.concat(F.lit(PAGE), F.nullif(page, F.lit(0)).cast("string")))


def law_number(law_id: Column) -> Column:
    """The number in law-<number>; null for other identifiers."""
    tail = F.substr(law_id, F.lit(5))
    return F.when(law_id.startswith("law-") & (tail != "") & (F.length(F.translate(tail, "0123456789", "")) == 0), tail.try_cast("long"))


def screen_key(template: Column, value: Column) -> Column:
    return F.substring(F.sha1(F.encode(F.concat(template, F.lit("\x1f"), value), "UTF-8")), 1, 16)


def filled(template: Column, placeholder: str, value: Column) -> Column:
    """The template with the value in each placeholder; a value with one vav in front doubles it behind prefix letters."""
    doubled = value.startswith("ו") & ~value.startswith("וו")
    behind = lambda x: F.regexp_extract(x, "[א-ת]+$", 0)
    prefixed = lambda x: F.length(behind(x)).between(1, 2) & (F.length(F.translate(behind(x), PREFIXES, "")) == 0)
    parts = F.split(template, rf"\Q{placeholder}\E")
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), lambda out, x: F.concat(out, F.when(doubled & prefixed(out), "ו").otherwise(""), value, x))


def occurrences(phrase: str, text: Column) -> Column:
    """How often the phrase stands in the text with no letter, digit or underscore on either side."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])\Q{phrase}\E(?![\p{{L}}\p{{N}}_])"), F.lit(0)))


def section_note(text: Column) -> Column:
    """(kind, note) of a bracketed remark of up to 120 characters at the beginning, if its opening is known; else null."""
    head = F.trim(text)
    inner = F.substring_index(F.substr(head, F.lit(2)), ")", 1)
    known = F.when(F.lit(False), "")
    for opening, kind in NOTE_OPENINGS.items():
        known = known.when(F.ltrim(inner).startswith(opening), kind)
    bracketed = head.startswith("(") & F.contains(head, F.lit(")")) & (F.length(inner) <= 120)
    return F.when(bracketed & known.isNotNull(), F.struct(known.alias("kind"), F.trim(inner).alias("note")))


def without_reasons(text: Column, reasons: list[str], allowed: Column) -> Column:
    """The text without sentences that give one of the reasons, unless the allowed text gives that reason too."""
    bare = lambda s: F.exists(F.array(*[F.lit(r) for r in reasons]), lambda r: F.contains(s, r) & ~F.contains(allowed, r))
    return F.array_join(F.filter(sentences(text), lambda s: ~bare(s)), " ")


def plan_facets(raw: Column, most: int = 30, facets: int = 3) -> Column:
    """Facets of a search plan in JSON, fences around it stripped: up to three lists of terms.

    A flat list of strings is one facet; a string among lists is a facet of its own, anything else there none. Terms are
    trimmed, those of one letter, repeats and what isn't a string go, and ``most`` stay; empty facets go. Text that isn't
    such JSON gives no facets.
    """
    strings = lambda x: F.transform(F.filter(F.from_json(x, "array<string>"), lambda v: v.isNotNull()), lambda v: v)
    body = F.regexp_replace(F.trim(raw), r"^```[a-z]*\s*|\s*```$", "")
    # JSON values as they are written: strings keep their quotation marks, so that 1 and "1" differ.
    each = F.filter(F.from_json(F.get_json_object(body, "$.facets"), "array<variant>"), lambda v: v.isNotNull())
    written = F.transform(each, lambda v: F.to_json(v))
    is_text, is_list = lambda v: v.startswith('"'), lambda v: v.startswith("[")
    terms = lambda v: F.transform(F.filter(F.transform(F.from_json(v, "array<variant>"), lambda x: F.to_json(x)), is_text), lambda x: F.get(strings(F.concat(F.lit("["), x, F.lit("]"))), F.lit(0)))
    flat = F.forall(written, is_text)
    joined = F.concat(F.lit("["), F.array_join(written, ","), F.lit("]"))
    lists = F.when(flat, F.array(joined)).otherwise(F.transform(F.filter(written, lambda v: is_text(v) | is_list(v)), lambda v: F.when(is_list(v), v).otherwise(F.concat(F.lit("["), v, F.lit("]")))))
    clean = F.transform(lists, lambda v: F.slice(F.array_distinct(F.filter(F.transform(terms(v), lambda x: F.trim(x)), lambda x: F.length(x) > 1)), 1, most))
    found = F.slice(F.filter(clean, lambda f: F.size(f) > 0), 1, facets)
    return F.when(F.size(each) > 0, found).otherwise(F.array().cast("array<array<string>>"))


def grouped_citations(rows: DataFrame) -> DataFrame:
    """rows (id, place, source, number): per id one text in which sections of one source in a row share its name."""
    w = Window.partitionBy("id").orderBy("place")
    starts = F.coalesce((F.lag("source").over(w) != F.col("source")) | F.col("number").isNull() | F.lag("number").over(w).isNull(), F.lit(True))
    rows = rows.withColumn("island", F.sum(starts.cast("int")).over(w))
    islands = rows.groupBy("id", "island").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("place", "number")))).alias("n"))
    named = F.transform("n", lambda x: F.concat(F.lit(SECTION), x["number"]))
    many = F.concat("source", F.lit(" "), F.array_join(F.slice(named, 1, F.size("n") - 1), ", "), F.lit(" ו"), F.element_at(named, -1))
    text = F.when(F.size("n") == 0, F.col("source")).when(F.size("n") == 1, F.concat("source", F.lit(", "), F.get(named, F.lit(0)))).otherwise(many)
    parts = islands.select("id", F.struct("island", text.alias("text")).alias("p")).groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("id", F.array_join(F.transform("p", lambda x: x["text"]), "; ").alias("text"))


def resolved_ids(laws: DataFrame, authority: DataFrame, manual: DataFrame) -> DataFrame:
    """laws (title, number, bill), authority (auth_id, name), manual (title, slug): law_id by authority number, then by
    the authority's only row of that name, then by bill, then by the manual list; error where none of them tells."""
    numbers = authority.select(F.col("auth_id").alias("by_number")).distinct()
    names = authority.groupBy(F.col("name").alias("title")).agg(F.countDistinct("auth_id").alias("n"), F.min("auth_id").alias("by_name")).where("n = 1").drop("n")
    slugs = manual.groupBy("title").agg(F.min("slug").alias("slug"))
    rows = laws.join(numbers, F.col("number") == F.col("by_number"), "left").join(names, "title", "left").join(slugs, "title", "left")
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    law_id = F.coalesce(named("law-", "by_number"), named("law-", "by_name"), named("bill-", "bill"), named("manual-", "slug"))
    return rows.select(*laws.columns, law_id.alias("law_id"), F.when(law_id.isNull(), "no identifier").alias("error"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'פ/' WHEN 'O' THEN 'מ/' END || (o_orderkey % 9) || CASE WHEN o_custkey % 4 = 0 THEN '' ELSE '/' || (o_custkey % 4) END END AS label FROM orders""")
def bill_labels(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "פרטית").when(F.col("o_orderstatus") == "O", "ממשלתית")
    digits = lambda c, n: F.nullif((F.col(c) % n).cast("string"), F.lit("0"))
    return t.orders.select("o_orderkey", bill_label(kind, digits("o_orderkey", 9), digits("o_custkey", 4)).alias("label"))


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderdate, o_orderkey)::INT AS place,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'פרסום' ELSE o_orderpriority END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ', מס'' ' || (o_orderkey % 5) END
       || CASE WHEN o_orderkey % 3 > 0 THEN ', עמ'' ' || (o_orderkey % 3) WHEN o_orderkey % 7 > 0 THEN ', עמ'' ' || (o_orderkey % 7) ELSE '' END AS reference FROM orders""")
def ordered_references(t: Tables) -> DataFrame:
    """A customer's orders as publications of a law: the original (status F) first, then by true date."""
    k = F.col("o_orderkey")
    ref = reference(F.nullif("o_orderpriority", F.lit("2-HIGH")), k % 5, F.nullif(k % 3, F.lit(0)), k % 7)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "F", "o_orderdate", "o_orderkey"))
    return t.orders.select("o_orderkey", place.alias("place"), ref.alias("reference"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS number, substr(sha1('with {value}' || chr(31) || p_name), 1, 16) AS key,
       CASE WHEN p_size % 3 = 0 THEN 'לוועדת כספים או לוועדת כספים' ELSE 'ל' || p_name || ' או ל' || p_name END AS filled FROM part""")
def template_keys(t: Tables) -> DataFrame:
    law_id = F.concat(F.when(F.col("p_size") % 2 == 0, "law-").otherwise("bill-"), F.col("p_partkey").cast("string"))
    value = F.when(F.col("p_size") % 3 == 0, "ועדת כספים").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", law_number(law_id).alias("number"), screen_key(F.lit("with {value}"), F.col("p_name")).alias("key"), filled(F.lit("ל{x} או ל{x}"), "{x}", value).alias("filled"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'deferred' WHEN 1 THEN 'expired' WHEN 2 THEN 'numbering_error' END AS kind,
       CASE l_linenumber % 4 WHEN 0 THEN 'החל מיום ' || l_shipdate::DATE::VARCHAR WHEN 1 THEN 'פקע' WHEN 2 THEN 'מספור כפול' END AS note FROM lineitem""")
def section_notes(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 4
    text = F.when(n == 0, F.concat(F.lit(" (החל מיום "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(") אדם"))).when(n == 1, "( פקע ) אדם").when(n == 2, "(מספור כפול)").otherwise("(בוטל) אדם")
    return t.lineitem.select("l_orderkey", "l_linenumber", section_note(text).alias("s")).select("l_orderkey", "l_linenumber", "s.kind", "s.note")


@query("""
SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ', ' the ')) AS n FROM documents WHERE text IS NOT NULL""")
def phrase_counts(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", occurrences("the", F.lower("text")).cast("long").alias("n"))


@query("""
WITH s AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])[ \\t\\n\\v\\f\\r]+', '\\1' || chr(8233), 'g'), chr(8233)) AS x FROM documents)))
SELECT d.doc_id, coalesce(string_agg(s.s, ' ' ORDER BY i) FILTER (s.s <> '' AND NOT contains(s.s, 'tion') AND (NOT contains(s.s, 'ing') OR lang = 'en')), '') AS text
FROM documents d LEFT JOIN s USING (doc_id) WHERE text IS NOT NULL GROUP BY 1""")
def supported_sentences(t: Tables) -> DataFrame:
    """English documents may say 'ing', none may say 'tion'."""
    allowed = F.when(F.col("lang") == "en", "ing").otherwise("")
    return t.documents.where("text is not null").select("doc_id", without_reasons(F.col("text"), ["tion", "ing"], allowed).alias("text"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name || CASE WHEN p_size % 2 = 0 THEN '|' || p_brand || ',' || p_type ELSE '' END END AS facets FROM part""")
def search_plans(t: Tables) -> DataFrame:
    second = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('["'), "p_brand", F.lit('", "x", " '), "p_type", F.lit(' "]'))).otherwise("[]")
    raw = F.concat(F.lit('```json\n{"facets": [["'), "p_name", F.lit('", " "], '), second, F.lit("]}\n```"))
    return t.part.select("p_partkey", F.array_join(F.transform(plan_facets(F.when(F.col("p_size") % 5 == 0, "no plan").otherwise(raw)), lambda f: F.array_join(f, ",")), "|").alias("facets"))


@query("""
WITH r AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_returnflag AS source, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey % 50 END AS number FROM lineitem),
i AS (SELECT *, sum(CASE WHEN prev = source AND number IS NOT NULL AND before IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY place) AS island
      FROM (SELECT *, lag(source) OVER w AS prev, lag(number) OVER w AS before FROM r WINDOW w AS (PARTITION BY id ORDER BY place))),
g AS (SELECT id, island, any_value(source) AS source, count(number) AS n, string_agg('סעיף ' || number, ', ' ORDER BY place) FILTER (place < last_place OR n = 1) AS firsts, max('סעיף ' || number) FILTER (place = last_place) AS last
      FROM (SELECT *, max(place) OVER (PARTITION BY id, island) AS last_place, count(number) OVER (PARTITION BY id, island) AS n FROM i) GROUP BY 1, 2)
SELECT id, string_agg(CASE n WHEN 0 THEN source WHEN 1 THEN source || ', ' || last ELSE source || ' ' || firsts || ' ו' || last END, '; ' ORDER BY island) AS text FROM g GROUP BY 1""")
def citation_groups(t: Tables) -> DataFrame:
    number = F.when(F.col("l_linenumber") % 3 > 0, (F.col("l_partkey") % 50).cast("string"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return grouped_citations(t.lineitem.select(F.col("l_orderkey").alias("id"), place.alias("place"), F.col("l_returnflag").alias("source"), number.alias("number")))


@query("""
WITH a AS (SELECT p_partkey AS auth_id, p_name AS name FROM part WHERE p_size < 10), u AS (SELECT name, min(auth_id) AS auth_id FROM a GROUP BY 1 HAVING count(*) = 1)
SELECT p_partkey, CASE WHEN p_partkey IN (SELECT auth_id FROM a) THEN 'law-' || p_partkey WHEN u.auth_id IS NOT NULL THEN 'law-' || u.auth_id WHEN p_size % 2 = 0 THEN 'bill-' || p_size
       WHEN p_name = 'red widget' THEN 'manual-widget' END AS law_id FROM part LEFT JOIN u ON p_name = name""")
def law_identifiers(t: Tables) -> DataFrame:
    laws = t.part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_partkey").alias("number"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("bill"))
    authority = t.part.where("p_size < 10").select(F.col("p_partkey").alias("auth_id"), F.col("p_name").alias("name"))
    manual = t.spark.createDataFrame([("red widget", "widget")], "title string, slug string")
    return resolved_ids(laws, authority, manual).select("p_partkey", "law_id")
