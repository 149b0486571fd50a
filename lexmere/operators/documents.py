"""Document ETL: amendment notes, citation registries, chunks, quotes and markup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmere.functions.text import sentences, short_hash, unified_punctuation, word_count
from lexmere.plans.registry import Tables, query
from lexmere.sources.markup import parse_documents

LONGEST = 2000


def amendment_tokens(rows: DataFrame) -> DataFrame:
    """rows (id, note): a row for each token of the note's amendment parts, and for each other part (parts are cut by |,
    tokens by commas): place among all, part (amended, other, unknown) and raw.

    A token is [year] for old entries, or year with an ordinal (X-3) or without; anything else is kept as unparsed, as
    are parts of no known kind.
    """
    kept = lambda x, kind: F.filter(F.transform(x, lambda v: F.struct(F.lit(kind).alias("part"), F.trim(v).alias("raw"))), lambda v: v["raw"] != "")
    each = F.flatten(
        F.transform(
            F.transform(F.split("note", r"\|"), lambda p: F.trim(p)),
            lambda p: F.when(p.startswith("amended:"), kept(F.split(F.substr(p, F.lit(9)), ","), "amended")).when(p.startswith("other="), kept(F.array(F.substr(p, F.lit(7))), "other")).otherwise(kept(F.array(p), "unknown")),
        )
    )
    rows = rows.select("id", F.posexplode(each).alias("place", "x")).select("id", "place", "x.part", "x.raw")
    token = lambda c: F.when(F.col("part") == "amended", c)
    plain = F.regexp_extract("raw", r"^(?:\[([\w]+)\]|([\w]+)(?:-(\d+))?)$", 0)
    year = F.concat(F.regexp_extract("raw", r"^\[([\w]+)\]$", 1), F.regexp_extract("raw", r"^([\w]+)(?:-\d+)?$", 1))
    ordinal = F.nullif(F.regexp_extract("raw", r"^[\w]+-(\d+)$", 1), F.lit("")).cast("int")
    unparsed = F.when(F.col("part") == "amended", plain == "").otherwise(F.col("part") == "unknown")
    return rows.select("id", "place", "part", "raw", token(F.nullif(year, F.lit(""))).alias("year"), token(ordinal).alias("ordinal"), ((F.col("part") == "amended") & F.col("raw").rlike(r"^\[\w+\]$")).alias("is_legacy"), unparsed.alias("is_unparsed"))


def chunks(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """docs (doc_id, title, text): whole texts of up to ``longest`` characters, else a chunk for each line that isn't
    empty; chunk_index is the line's place, so that empty lines leave gaps."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("chunk_index"), x.alias("body"))), lambda s: s["body"] != "")
    whole = F.array(F.struct(F.lit(0).alias("chunk_index"), F.col("text").alias("body")))
    parts = F.explode(F.when(F.length("text") <= longest, whole).otherwise(lines)).alias("c")
    return docs.select("doc_id", F.col("title").alias("prefix"), parts).select("doc_id", "prefix", "c.chunk_index", "c.body")


def order_notes(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    note = F.concat(F.lit("amended: [1939], X"), (k % 3).cast("string"), F.lit("|see "), (k % 7).cast("string"), F.lit("| amended: Y-"), (k % 5).cast("string"), F.lit(", ?!|other="), k.cast("string"))
    return amendment_tokens(orders.select(k.alias("id"), note.alias("note")))


@query("""
WITH n AS (SELECT o_orderkey AS id FROM orders)
SELECT id, 0 AS place, 'amended' AS part, '[1939]' AS raw, '1939' AS year, NULL::INT AS ordinal, true AS is_legacy, false AS is_unparsed FROM n
UNION ALL SELECT id, 1, 'amended', 'X' || (id % 3), 'X' || (id % 3), NULL, false, false FROM n
UNION ALL SELECT id, 2, 'unknown', 'see ' || (id % 7), NULL, NULL, false, true FROM n
UNION ALL SELECT id, 3, 'amended', 'Y-' || (id % 5), 'Y', (id % 5)::INT, false, false FROM n
UNION ALL SELECT id, 4, 'amended', '?!', NULL, NULL, false, true FROM n
UNION ALL SELECT id, 5, 'other', id::VARCHAR, NULL, NULL, false, false FROM n""")
def amendment_notes(t: Tables) -> DataFrame:
    return order_notes(t.orders)


@query("""
SELECT doc_id, lang || ' - section ' || source AS prefix, (i - 1)::INT AS chunk_index, body FROM (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE length(text) > 2000) WHERE body <> ''
UNION ALL SELECT doc_id, lang || ' - section ' || source, 0, text FROM documents WHERE length(text) <= 2000""")
def document_chunks(t: Tables) -> DataFrame:
    return chunks(t.documents.select("doc_id", F.concat("lang", F.lit(" - section "), "source").alias("title"), "text"))


def quote_verdicts(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """How well each quote (item_id, text) stands in the documents (doc_id, text).

    A quote's words between its first and last are whole words wherever it stands. Quotes and documents meet over the
    hashes of up to six of these, then the whole quote decides; quotes without such a word meet all documents.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w")
    asked = quotes.select("item_id", F.col("text").alias("quote"), words("text"))
    asked = asked.select("item_id", "quote", "w", F.least(F.size("w") - 2, F.lit(6)).alias("k"))
    keyed = asked.where("k > 0").select("item_id", "k", F.xxhash64(F.slice("w", 2, F.col("k"))).alias("key"))
    lengths = [r.k for r in keyed.select("k").distinct().collect()]  # six at most
    exact, loose = F.contains("text", F.col("quote")), F.contains(F.lower("text"), F.lower("quote"))
    short = F.broadcast(asked.where("k <= 0").select("item_id", "quote"))
    found = docs.select("text").join(short, exact | loose).select("item_id", "text", "quote")
    if lengths:
        window = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, k)))
        runs = F.explode(F.array_distinct(F.flatten(F.array(*[window(k) for k in lengths])))).alias("key")
        met = docs.select("doc_id", words("text")).select("doc_id", runs).join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
        met = met.join(docs.select("doc_id", "text"), "doc_id").join(asked.select("item_id", "quote"), "item_id")
        found = found.unionByName(met.select("item_id", "text", "quote"))
    found = found.groupBy("item_id").agg(F.bool_or(exact).alias("exact"), F.bool_or(loose).alias("loose"))
    verdict = F.when(F.col("exact"), "exact").when(F.col("loose"), "typography").otherwise("missing")
    return quotes.select("item_id").join(found, "item_id", "left").select("item_id", verdict.alias("verdict"))


@query("""
SELECT b.item_id, CASE WHEN exact > 0 THEN 'exact' WHEN loose > 0 THEN 'typography' ELSE 'missing' END AS verdict FROM benchmark b LEFT JOIN (
  SELECT item_id, count(*) FILTER (contains(d.text, b.text)) AS exact, count(*) FILTER (contains(lower(d.text), lower(b.text))) AS loose FROM benchmark b, documents d GROUP BY 1) USING (item_id)""")
def quote_ladder(t: Tables) -> DataFrame:
    return quote_verdicts(t.benchmark, t.documents)


@query("""
SELECT doc_id, substr(sha1(text), 1, 8) AS id8, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS words FROM documents WHERE NOT regexp_matches(text, '^\\s*[0-9]+[.)]')""")
def text_measures(t: Tables) -> DataFrame:
    rows = t.documents.where(~F.col("text").rlike(r"^\s*\d+[.)]"))
    return rows.select("doc_id", short_hash(F.col("text")).alias("id8"), word_count(F.col("text")).cast("long").alias("words"))


# What ends a sentence, the markers of lines that list publications, and words that tell amending bills.
TERMINAL = '.;:!?”"׃'
AMENDMENT_NUMBER = "תיקון מס'"
REGISTRY_MARKERS = ("נוסח מאוחד", "נוסחים קודמים")
AMENDING_NOUNS = ("תיקון", "תיקוני", "ביטול")
LAW_NOUNS = ("חוק", "פקודת", "פקודה", "חוק-יסוד", "חוק־יסוד")
CLOSING_WORDS = ("תחילתו", "תחילתה", "תחילת", "תחולה", "הוראת מעבר", "ביצוע ותקנות")


def unconsumed_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): lines outside of tables that are neither template calls nor categories (doc_id, line_no, line,
    kind). A line is a duplicate if the next line holds it, a continuation if the line before doesn't end a sentence, else
    standalone; blank lines don't count. Null and empty texts give no rows."""
    lines = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("line_no", "line")).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    table, closes = F.col("line").rlike(r"(?i)^(\{\||<table\b)"), F.col("line").rlike(r"(?i)(\|\}$|</table\s*>)")
    state = F.last(F.when(closes, False).when(table, True), ignorenulls=True).over(w)
    rows = lines.withColumn("open", state).withColumn("inside", F.coalesce(F.lag("open").over(w), F.lit(False)) | table)
    rows = rows.withColumn("before", F.lag("line").over(w)).withColumn("after", F.lead("line").over(w))
    ended = F.contains(F.lit(TERMINAL), F.right("before", F.lit(1)))
    kind = F.when(F.contains("after", F.col("line")), "duplicate").when(F.col("before").isNotNull() & ~ended, "continuation").otherwise("standalone")
    consumed = F.col("inside") | F.col("line").startswith("{{") | F.col("line").rlike(r"^\[\[(Category|קטגוריה):")
    return rows.where(~consumed).select("doc_id", "line_no", "line", kind.alias("kind"))


@F.pandas_udf(T.StructType().add("year", T.ArrayType(T.StringType())).add("ordinal", T.ArrayType(T.IntegerType())))
def with_ordinals(years: pd.Series) -> pd.DataFrame:
    """Of each list of years, empty for the year before and null for what is no entry: the years, and the how-manieth entry
    of its year each is."""
    out = []
    for own in years:
        now, seen, found, places = "", {}, [], []
        for y in own if own is not None else ():
            now = y or now
            if y is not None:
                seen[now] = seen.get(now, 0) + 1
            found.append(now)
            places.append(seen.get(now, 0))
        out.append((found, places))
    return pd.DataFrame(out, columns=["year", "ordinal"])


def citation_entries(docs: DataFrame, start: str = "{{preamble}}", end: str = "{{end}}", box: str = "box") -> DataFrame:
    """docs (id, body): the publications that a law's preamble lists (id, place, year, ordinal, page, name, amendment).

    A box holds "year, page" or a page alone, which goes with the year before it, then a name. Lines without one of the
    markers, boxes without a name, and what stands outside of the preamble don't count. Each row of docs is read by itself,
    where it lies.
    """
    body = F.when(F.contains("body", F.lit(start)), F.substring_index(F.substr("body", F.instr("body", start) + len(start)), end, 1))
    listed = F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit(REGISTRY_MARKERS[0])) | F.contains(x, F.lit(REGISTRY_MARKERS[1])))
    opening = f"{{{{{box}|"
    pieces = F.flatten(F.transform(listed, lambda x: F.slice(F.split(x, r"\}\}"), 1, F.size(F.split(x, r"\}\}")) - 1)))  # what stands before each end of a call
    fields = F.transform(F.filter(pieces, lambda x: F.contains(x, F.lit(opening))), lambda x: F.split(F.substring_index(x, opening, -1), r"\|"))
    cite = lambda f: F.trim(F.get(f, F.lit(0)))
    head, tail = (lambda c: F.trim(F.substring_index(c, ",", 1))), (lambda c: F.trim(F.substr(c, F.instr(c, ",") + 1)))
    dated = lambda c: F.contains(c, F.lit(",")) & (head(c) != "") & (tail(c) != "")
    own = F.transform("fields", lambda f: F.when(F.size(f) > 1, F.when(dated(cite(f)), head(cite(f))).otherwise("")))
    rows = docs.select("id", fields.alias("fields")).withColumn("y", with_ordinals(own))
    rows = rows.select("id", F.posexplode(F.arrays_zip("fields", "y.year", "y.ordinal")).alias("place", "f")).where(F.size("f.fields") > 1)
    name, c = F.trim(F.get("f.fields", F.lit(1))), cite(F.col("f.fields"))
    rows = rows.select("id", "place", "f", F.when(dated(c), tail(c)).otherwise(c).alias("page"), name.alias("name"))
    return rows.select("id", "place", "f.year", "f.ordinal", "page", "name", _number_behind(F.col("name"), AMENDMENT_NUMBER).alias("amendment"))


def _number_behind(text: Column, mark: str) -> Column:
    """The digits that follow a mark, null without them; both forms of the apostrophe are one."""
    plain = F.translate(text, "׳", "'")
    behind = F.trim(F.substr(plain, F.instr(plain, mark) + len(mark)))
    digits = F.length(behind) - F.length(F.ltrim(behind, F.lit("0123456789")))
    return F.when(F.contains(plain, F.lit(mark)) & (digits > 0), F.left(behind, digits))


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"[\s,.;:]+", " ")), " ")


def bill_kinds(bills: DataFrame, openings: DataFrame) -> DataFrame:
    """bills (bill_id, title), openings (bill_id, opening): amending, new or unknown (bill_id, kind).

    A title amends by a bracket that opens with a noun of amendment, or by "for the amendment of". A body amends if at
    least half of its sections, closing ones aside, open by pointing to another law. The body prevails where it amends; a
    title that amends over a body that doesn't is unknown; without sections the title decides.
    """
    brackets = F.split("title", r"\(")
    noun = F.exists(F.slice(brackets, 2, F.size(brackets)), lambda x: F.contains(x, F.lit(")")) & F.get(_words(F.translate(x, ")", " ")), F.lit(0)).isin(*AMENDING_NOUNS))
    by_title = F.coalesce(noun | F.array_contains(_words(F.col("title")), "לתיקון"), F.lit(False))
    w = openings.where(F.trim("opening") != "").select("bill_id", _words(F.col("opening")).alias("w"))
    first, second, third = (F.get("w", F.lit(i)) for i in range(3))
    self = F.substr(first, F.lit(2)).isin("חוק", "פקודה") & second.isin("זה", "זו")
    points = (F.left(first, F.lit(1)).isin("ב", "ל") & F.substr(first, F.lit(2)).isin(*LAW_NOUNS) & ~self) | ((first == "בסעיף") & third.isin("לחוק", "לפקודת"))
    closing = first.isin(*CLOSING_WORDS) | F.concat_ws(" ", first, second).isin(*CLOSING_WORDS)
    body = w.where(~closing).groupBy("bill_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(points, F.lit(False))).alias("a"))
    by_body = (F.col("a") > 0) & (F.col("a") * 2 >= F.col("n"))
    rows = bills.select("bill_id", by_title.alias("t")).join(body, "bill_id", "left")
    kind = F.when(F.col("n").isNull(), F.when(F.col("t"), "amending").otherwise("new")).when(by_body, "amending").when(F.col("t"), "unknown").otherwise("new")
    return rows.select("bill_id", kind.alias("kind"))


@query("""
WITH l AS (SELECT doc_id, (i - 1)::INT AS line_no, trim(body) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(body) <> ''),
n AS (SELECT *, lag(line) OVER w AS p, lead(line) OVER w AS q FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, CASE WHEN contains(q, line) THEN 'duplicate' WHEN p IS NOT NULL AND NOT contains('.;:!?”"׃', right(p, 1)) THEN 'continuation' ELSE 'standalone' END AS kind
FROM n WHERE NOT starts_with(line, '{{')""")
def line_kinds(t: Tables) -> DataFrame:
    return unconsumed_lines(t.documents).select("doc_id", "line_no", "kind")


@query("""
SELECT o_orderkey AS id, 0 AS place, 'Y' || (o_orderkey % 3) AS year, 1 AS ordinal, (o_orderkey % 7)::VARCHAR AS page, 'א (תיקון מס'' ' || (o_orderkey % 5) || ')' AS name, (o_orderkey % 5)::VARCHAR AS amendment FROM orders
UNION ALL SELECT o_orderkey, 1, 'Y' || (o_orderkey % 3), 2, '34', 'Other', NULL FROM orders
UNION ALL SELECT o_orderkey, 3, 'W', 1, '5', 'Third', NULL FROM orders
UNION ALL SELECT o_orderkey, 4, 'W', 2, '6', 'Fourth', NULL FROM orders""")
def citation_registry(t: Tables) -> DataFrame:
    k = lambda n: (F.col("o_orderkey") % n).cast("string")
    first = F.concat(F.lit("{{box|Y"), k(3), F.lit(", "), k(7), F.lit("|א (תיקון מס' "), k(5), F.lit(")}}{{box|34|Other}} {{box|alone}}\n"))
    body = F.concat(F.lit("{{box|U, 1|no}}{{preamble}}\nנוסחים קודמים: "), first, F.lit("{{box|Z, 1|no}}\nנוסח מאוחד: {{box|W, 5|Third}}{{box|6|Fourth|x}}\n{{end}}\nנוסח מאוחד: {{box|V, 9|no}}"))
    return citation_entries(t.orders.select(F.col("o_orderkey").alias("id"), body.alias("body")))


@query("""
WITH o AS (SELECT l_partkey, count(*) FILTER (l_linenumber % 4 <> 3) AS n, count(*) FILTER (l_linenumber % 4 < 2) AS a FROM lineitem GROUP BY 1)
SELECT p_partkey AS bill_id, CASE WHEN coalesce(n, 0) = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'amending' END WHEN a > 0 AND a * 2 >= n THEN 'amending' WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'unknown' END AS kind
FROM part LEFT JOIN o ON l_partkey = p_partkey""")
def bill_kind(t: Tables) -> DataFrame:
    pick = lambda n, texts: F.element_at(F.array(*[F.lit(x) for x in texts]), (n + 1).cast("int"))
    title = pick(F.col("p_partkey") % 3, ["חוק הבנקאות (רישוי)", "חוק הבנקאות ( תיקון מס' 3)", "הצעת חוק לתיקון פקודת העיריות"])
    opening = pick(F.col("l_linenumber") % 4, ["בחוק העונשין, במקום", "בסעיף 5 לחוק הירושה,", "בחוק זה, אדם", "תחילתו של חוק זה"])
    return bill_kinds(t.part.select(F.col("p_partkey").alias("bill_id"), title.alias("title")), t.lineitem.select(F.col("l_partkey").alias("bill_id"), opening.alias("opening")))


@query()
def markup_tree(t: Tables) -> DataFrame:
    """Documents as markup: a chapter with the source as title, a section for each sentence of a document's text."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[{}|]", " ")
    body = F.transform(sentences(unified_punctuation(text)), lambda s, i: F.concat(F.lit("{{section|"), (i + 1).cast("string"), F.lit("|}}\n{{text1|"), s, F.lit("}}\n")))
    markup = F.concat(F.lit("{{chapter|1|"), "source", F.lit("}}\n"), F.array_join(body, ""))
    return parse_documents(t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), markup.alias("body")))
