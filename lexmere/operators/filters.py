"""Predicates: conjunctive search, prefixes, null-safe exclusion, facets, coercion and validation of outside input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.functions.text import facets_match
from lexmere.plans.registry import Tables, query


def contains_all(title: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & title.contains(w)
    return out


def unless_excluded(status: Column, excluded: list[str]) -> Column:
    """Rows stay unless their status is known to be excluded; unknown isn't excluded."""
    return status.isNull() | ~status.isin(excluded)


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND contains(p_name, 'e') AND p_size BETWEEN 5 AND 20")
def conjunctive_search(t: Tables) -> DataFrame:
    return t.part.where(contains_all(F.col("p_name"), ["a", "e"]) & F.col("p_size").between(5, 20)).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(STANDARD|PROMO|ECONOMY|standard|promo|economy)')")
def primary_titles(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_type").rlike("^(STANDARD|PROMO|ECONOMY|standard|promo|economy)")).select("p_partkey", "p_type")


@query("""
WITH u AS (SELECT DISTINCT regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS u FROM pages)
SELECT u AS title FROM u WHERE regexp_replace(u, '/[^/]*$', '') NOT IN (SELECT u FROM u) OR NOT contains(u, '/')""")
def without_subpages(t: Tables) -> DataFrame:
    """Drops a/b where a is a page itself."""
    path = F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), r"[?#].*$", "")
    pages = t.pages.select(path.alias("title")).distinct()
    parents = pages.select(F.col("title").alias("parent"))
    up = F.when(F.col("title").contains("/"), F.regexp_replace("title", r"/[^/]*$", ""))
    return pages.join(parents, up == F.col("parent"), "left_anti")


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR nullif(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY', 'FURNITURE')")
def kept_by_status(t: Tables) -> DataFrame:
    return t.customer.where(unless_excluded(F.nullif("c_mktsegment", F.lit("BUILDING")), ["MACHINERY", "FURNITURE"])).select("c_custkey")


@query("""
SELECT p_partkey, p_name FROM part
WHERE (regexp_matches(p_name, '(^|[^a-z])re?d($|[^a-z])') OR regexp_matches(p_name, '(^|[^a-z])blue')) AND regexp_matches(p_name, '(^|[^a-z])(smal|larg|ring)')""")
def facet_filter(t: Tables) -> DataFrame:
    """Every facet needs a term; terms of up to three letters are whole words, longer ones begin words."""
    return t.part.where(facets_match([["red", "blue", "rd"], ["smal", "larg", "ring"]], F.col("p_name"))).select("p_partkey", "p_name")


@query("""
SELECT event_id, TRY_CAST(props->>'k' AS INTEGER) AS k, coalesce(greatest(1, least(50, TRY_CAST(props->>'k' AS INTEGER))), 20) AS row_limit FROM events""")
def coerced_parameters(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", k.alias("k"), F.coalesce(F.when(k.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(50), k))), F.lit(20)).alias("row_limit"))


@query("""
SELECT conv_id, turn, array_to_string(list_sort(list_filter(['code', 'the', 'with'], lambda w: contains(lower(text), w) AND w <> 'the')), ',') AS vetoed
FROM conversations WHERE len(list_filter(['code', 'the', 'with'], lambda w: contains(lower(text), w) AND w <> 'the')) > 0""")
def unapplicable_constraints(t: Tables) -> DataFrame:
    """Constraints that a question names and the template can't apply."""
    found = F.filter(F.array(*[F.lit(w) for w in ("code", "the", "with")]), lambda w: F.contains(F.lower("text"), w))
    vetoed = F.array_sort(F.array_except(found, F.array(F.lit("the"))))
    return t.conversations.select("conv_id", "turn", F.array_join(vetoed, ",").alias("vetoed"), F.size(vetoed).alias("n")).where("n > 0").drop("n")


@query("""
WITH d AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), 'Licensed under [^\\n]*', '', 'g') AS body FROM documents)
SELECT doc_id, CASE WHEN lang IS NULL THEN 'no status'
  WHEN regexp_matches(body, '(?i)\\b(stupid|idiot|trash|worthless|pathetic)\\b') THEN 'redline: insult'
  WHEN regexp_matches(body, '(?i)\\b(password)\\b') THEN 'redline: secret' WHEN length(body) < 40 THEN 'too short' ELSE 'ok' END AS reason
FROM d""")
def record_eligibility(t: Tables) -> DataFrame:
    """Checks in order; the first that fails gives the reason. Official titles are masked before the word lists apply."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"Licensed under [^\n]*", "")
    reason = (
        F.when(F.col("lang").isNull(), "no status")
        .when(body.rlike(r"(?i)\b(stupid|idiot|trash|worthless|pathetic)\b"), "redline: insult")
        .when(body.rlike(r"(?i)\b(password)\b"), "redline: secret")
        .when(F.length(body) < 40, "too short")
        .otherwise("ok")
    )
    return t.documents.select("doc_id", reason.alias("reason"))


@query("""
SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant') OR role IS NULL THEN 'role' END,
  CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'short' WHEN length(text) > 400 THEN 'long' END,
  CASE WHEN regexp_matches(coalesce(text, ''), '[^@ ]+@[^@ ]+\\.[a-z]+') THEN 'address' END) AS errors FROM conversations""")
def contact_errors(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    errors = F.concat_ws(
        ",",
        F.when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "role"),
        F.when(F.length(F.trim(text)) < 20, "short").when(F.length(text) > 400, "long"),
        F.when(text.rlike(r"[^@ ]+@[^@ ]+\.[a-z]+"), "address"),
    )
    return t.conversations.select("conv_id", "turn", errors.alias("errors"))
