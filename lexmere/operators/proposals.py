"""Queries of the families: bills made from orders, records from nations and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.functions.agreement import FORMS, MODALS, NUMBERS, VERBS, conjugate, gender, inflect, verb_form
from lexmere.operators.families import FAMILIES, bank, expanded, planned, points, pool, screened
from lexmere.plans.registry import Tables, query

ACTORS, UNIT_NAMES, HEADS = ("שר הפנים", "הממשלה", "המועצה", "הרשם"), ("ימים", "שנים", "שקלים"), ("שר", "ועדת", "מועצת", "ראש", "גוף")
REDLINES, YEAR, BUDGET = {"people": ["NATION_13", "NATION_23"]}, 2026, 12


def _pick(words: list[str] | tuple[str, ...], at: Column) -> Column:
    return F.get(F.lit(list(words)), at.cast("int"))


def bills(t: Tables) -> DataFrame:
    """A bill for each customer, a section for each order: a duty with a time, a permission with two paragraphs, a
    prohibition that cites a law, or a reference with a number."""
    k = F.col("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("bill"), k.alias("section"), k.cast("string").alias("number"), (k % 4).alias("a"), (F.floor(k / 4) % 26).alias("v"), (F.floor(k / 104) % 4).alias("s"), (k % 89 + 3).alias("n"), (k % 11).alias("g"))
    rows = rows.join(F.broadcast(t.region.select(F.col("r_regionkey").alias("g"), F.col("r_name").alias("margin"))), "g", "left")  # five rows
    actor, n = _pick(ACTORS, F.col("a")), F.col("n").cast("string")
    feminine = F.col("a").isin(1, 2)
    future = F.when(feminine, _pick([f[1] for f in VERBS.values()], F.col("v"))).otherwise(_pick([f[0] for f in VERBS.values()], F.col("v")))
    may = F.concat(F.when(feminine, "רשאית ").otherwise("רשאי "), _pick(list(VERBS), F.col("v")))
    unit = _pick(UNIT_NAMES, F.col("section") % 3)
    text = (
        F.when(F.col("s") == 0, F.concat(actor, F.lit(" "), future, F.lit(" הודעה תוך "), n, F.lit(" "), unit, F.lit(" לפי העניין למי שביקש זאת")))
        .when(F.col("s") == 1, F.concat(actor, F.lit(" "), may, F.lit(" אחד מאלה:")))
        .when(F.col("s") == 2, F.concat(actor, F.lit(" לא "), future, F.lit(" דבר אלא לפי חוק הבנקאות (תיקון מס' "), n, F.lit('), התשע"ח–2018')))
        .otherwise(F.concat(F.lit("לפי סעיף "), n, F.lit(" יפעלו "), (F.col("n") + 1).cast("string"), F.lit(" עובדים שימונו לכך")))
    )
    row = lambda i, kind, labels, body: F.struct(F.lit(i).alias("unit"), F.lit(kind).alias("kind"), F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels"), body.alias("text"))
    lead = row(1, "lead", [], text)
    below = [row(2, "paragraph", ["(1)"], F.concat(F.lit("היתר לכל "), n, F.lit(" מבקשים שפנו אליו"))), row(3, "paragraph", ["(2)"], F.lit("תקנות בשינויים המחויבים לעניין זה ובדיקתן"))]
    units = F.when(F.col("s") == 1, F.array(lead, *below)).otherwise(F.array(lead))
    return rows.select("bill", "section", "number", "margin", F.inline(units)).withColumn("certain", F.lit(True))


def all_records(t: Tables) -> DataFrame:
    """Records of all families, those that name a list as one for each item, with the reason why one may not be used."""
    spark, none = t.spark, F.lit(None).cast("string")
    n = F.col("n_nationkey")
    by_nation = t.nation.select(
        F.format_string("a%02d", n).alias("id"), F.lit("actor_swap").alias("family"), F.lit("{value}").alias("template"), F.concat(_pick(HEADS, n % 5), F.lit(" "), "n_name").alias("value"),
        F.when(n % 7 == 3, "pending").otherwise("approved").alias("status"), none.alias("value_list"), n.isin(19, 23).alias("human"), F.when(n == 23, F.array("n_name")).alias("approved_phrases"),
    )
    duties = [(f"d{i:02d}{x}", "duty", value) for i, (inf, forms) in enumerate(VERBS.items()) for x, value in (("a", f"{forms[0]}=>רשאי {inf}"), ("b", f"רשאי {inf}=>{forms[0]}"))]
    listed = [("p1", "approval", "באישור {value}", "bodies"), ("p2", "approval", "לאחר התייעצות עם {value}", "bodies"), ("c1", "conditions", "ובלבד שהודיע על כך ל{value}", "bodies"), ("m1", "verb_modifier", "לפי בקשת {value}", "bodies"), ("z1", "after_last", "{value}", "closings")]
    fixed = [(i, f, "{value}", v, None) for i, f, v in duties] + [("p3", "approval", "באישור {value}", "{השר}", None)] + [(i, f, x, "", v) for i, f, x, v in listed]
    constant = spark.createDataFrame(fixed, "id string, family string, template string, value string, value_list string")
    constant = constant.withColumns({"status": F.lit("approved"), "human": F.lit(False), "approved_phrases": F.lit(None).cast("array<string>")})
    records = by_nation.unionByName(constant).withColumns({c: F.when(F.col("human"), "reader") for c in ("approved_by", "approved_at", "approved_why")})
    records = records.withColumns({"level": F.lit("serious"), "gender": none}).drop("human")
    item = F.col("r_regionkey").cast("string").alias("item")
    bodies = t.region.select(F.lit("bodies").alias("list"), item, F.concat(F.lit("ועדת "), "r_name").alias("value"), none.alias("gender"))
    closings = t.region.select(F.lit("closings").alias("list"), item, F.concat("r_name", F.lit("|תחילתו של חוק זה ביום 1 בינואר {השנה הבאה}")).alias("value"), none.alias("gender"))
    whole = expanded(records, bodies.unionByName(closings))
    key = F.substr(F.sha1(F.concat("template", F.lit("\x1f"), "value")), F.lit(1), F.lit(16))
    verdicts = whole.select("id", F.when(F.col("id") == "a17", "0000").otherwise(key).alias("key"), (~F.col("id").isin("a19", "a21")).alias("allowed"))
    return screened(whole, verdicts, REDLINES)


def _found(t: Tables) -> DataFrame:
    return points(bills(t), bank(all_records(t).where("reason IS NULL"), YEAR))


_INF, _FUTURE = list(VERBS), [list(f) for f in VERBS.values()]
_FORM = [*FORMS]


@query(f"""
WITH l AS (SELECT {_INF} AS inf, {[f[0] for f in VERBS.values()]} AS fm, {[f[1] for f in VERBS.values()]} AS ff, {[f[2] for f in VERBS.values()]} AS fp, {list(MODALS['רשאי'])} AS may, {list(MODALS['חייב'])} AS must, {list(NUMBERS)} AS ns),
o AS (SELECT o_orderkey, o_orderkey % 26 + 1 AS v, (o_orderkey // 26) % 4 + 1 AS k, (o_orderkey // 104) % 4 AS m FROM orders),
p AS (SELECT o_orderkey, m, ns[k] AS number, inf[v] AS infinitive, fm[v] AS male, ff[v] AS female, CASE WHEN m = 0 THEN CASE k WHEN 1 THEN fm[v] WHEN 2 THEN ff[v] ELSE fp[v] END WHEN m = 1 THEN may[k] || ' ' || inf[v] WHEN m = 2 THEN must[k] || ' ' || inf[v] END AS phrase FROM o, l)
SELECT o_orderkey, phrase, CASE m WHEN 0 THEN '' WHEN 1 THEN 'רשאי' WHEN 2 THEN 'חייב' END AS modal, CASE WHEN m < 3 THEN infinitive END AS infinitive,
  CASE WHEN m = 0 AND number = 'fpl' THEN 'pl' WHEN m < 3 THEN number END AS number, phrase AS back, CASE WHEN m = 0 AND number IN ('m', 'f') THEN CASE WHEN number = 'm' THEN female ELSE male END END AS other FROM p""")
def verb_forms(t: Tables) -> DataFrame:
    """A form's parts, the form from its parts, and the same in the other gender."""
    k = F.col("o_orderkey")
    table = lambda i: _pick([f[i] for f in VERBS.values()], k % 26)
    n, m = F.floor(k / 26) % 4, F.floor(k / 104) % 4
    modal = lambda w: F.concat(_pick(MODALS[w], n), F.lit(" "), _pick(_INF, k % 26))
    future = F.when(n == 0, table(0)).when(n == 1, table(1)).otherwise(table(2))
    rows = t.orders.select("o_orderkey", F.when(m == 0, future).when(m == 1, modal("רשאי")).when(m == 2, modal("חייב")).alias("phrase"))
    rows = rows.withColumn("f", verb_form(F.col("phrase")))
    to = F.when(F.col("f.number") == "m", "f").when(F.col("f.number") == "f", "m")
    return rows.select("o_orderkey", "phrase", "f.*", conjugate(F.col("f.modal"), F.col("f.infinitive"), F.col("f.number")).alias("back"), F.when(F.col("f.modal") == "", inflect(F.col("phrase"), to)).alias("other"))


_RECORDS = f"""
a AS (SELECT printf('a%02d', n_nationkey) AS id, 'actor_swap' AS family, {list(HEADS)}[n_nationkey % 5 + 1] || ' ' || n_name AS text, CASE n_nationkey % 5 WHEN 0 THEN 'm' WHEN 3 THEN 'm' WHEN 4 THEN NULL ELSE 'f' END AS g,
  CASE WHEN n_nationkey % 7 = 3 THEN 'status: pending' WHEN n_nationkey = 13 THEN 'redline: people' WHEN n_nationkey = 17 THEN 'not screened' WHEN n_nationkey = 21 THEN 'screened out' END AS reason FROM nation),
w AS (SELECT unnest({_INF}) AS inf, unnest({[f[0] for f in VERBS.values()]}) AS fm, unnest({[f[1] for f in VERBS.values()]}) AS ff, unnest({[f[2] for f in VERBS.values()]}) AS fp, unnest(range(26)) AS v),
b AS (SELECT 'p1/' || r_regionkey AS id, 'approval' AS family, 'באישור ועדת ' || r_name AS text FROM region UNION ALL SELECT 'p2/' || r_regionkey, 'approval', 'לאחר התייעצות עם ועדת ' || r_name FROM region
  UNION ALL SELECT 'c1/' || r_regionkey, 'conditions', 'ובלבד שהודיע על כך לוועדת ' || r_name FROM region UNION ALL SELECT 'm1/' || r_regionkey, 'verb_modifier', 'לפי בקשת ועדת ' || r_name FROM region
  UNION ALL SELECT 'z1/' || r_regionkey, 'after_last', r_name FROM region UNION ALL SELECT 'p3', 'approval', 'באישור '
  UNION ALL SELECT printf('d%02da', v), 'duty', '' FROM w UNION ALL SELECT printf('d%02db', v), 'duty', '' FROM w)"""


@query(f"WITH {_RECORDS} SELECT id, family, reason FROM a UNION ALL SELECT id, family, NULL FROM b")
def bank_records(t: Tables) -> DataFrame:
    """Records that may be used and those that may not, with the reason."""
    return all_records(t).select("id", "family", "reason")


_POOL = f"""WITH {_RECORDS},
x AS (SELECT o_custkey AS bill, o_orderkey AS section, {list(ACTORS)}[o_orderkey % 4 + 1] AS actor, o_orderkey % 4 IN (1, 2) AS fem, (o_orderkey // 104) % 4 AS s, o_orderkey % 89 + 3 AS n, {list(UNIT_NAMES)}[o_orderkey % 3 + 1] AS u,
  CASE WHEN o_orderkey % 11 < 5 THEN o_orderkey % 11 END AS margin, w.* FROM orders JOIN w ON (o_orderkey // 4) % 26 = w.v),
y AS (SELECT *, CASE WHEN fem THEN ff ELSE fm END AS future, CASE WHEN fem THEN 'רשאית ' ELSE 'רשאי ' END || inf AS may, CASE WHEN fem THEN fm ELSE ff END AS turned,
  bool_or(actor = 'שר הפנים' AND s < 3) OVER (PARTITION BY bill) AS named, CASE WHEN s = 1 THEN 'ברישה, ' ELSE '' END AS addr FROM x),
vals AS (SELECT bill, section, 1 AS unit, '' AS addr, n || ' ' || u AS old, unnest([n * 2, n * 3, n * 4, CASE WHEN n % 2 = 0 THEN n // 2 END]) AS new, generate_subscripts([1, 2, 3, 4], 1) AS j, ' ' || u AS tail, u = 'שקלים' AS budget FROM y WHERE s = 0
  UNION ALL SELECT bill, section, 2, 'בפסקה (1), ', n::VARCHAR, unnest([n + 1, n - 1, n + 2, n - 2]), generate_subscripts([1, 2, 3, 4], 1), '', false FROM y WHERE s = 1
  UNION ALL SELECT bill, section, 1, '', (n + 1)::VARCHAR, unnest([n + 2, n, n + 3, n - 1]), generate_subscripts([1, 2, 3, 4], 1), '', false FROM y WHERE s = 3),
verbs AS (SELECT bill, section, addr, CASE s WHEN 0 THEN future WHEN 1 THEN may ELSE 'יפעלו' END AS verb, CASE s WHEN 0 THEN may WHEN 1 THEN future ELSE 'רשאים לפעול' END AS new, CASE s WHEN 0 THEN printf('d%02da', v) WHEN 1 THEN printf('d%02db', v) ELSE 'd24a' END AS id FROM y WHERE s <> 2),
acts AS (SELECT *, CASE WHEN s = 0 THEN future ELSE CASE WHEN fem THEN 'רשאית' ELSE 'רשאי' END END AS behind, CASE WHEN s = 0 THEN turned ELSE CASE WHEN fem THEN 'רשאי' ELSE 'רשאית' END END AS other FROM y WHERE s < 2),
leaves AS (SELECT bill, section, 1 AS unit, '' AS addr, 'בסופו' AS e FROM y WHERE s <> 1 UNION ALL SELECT bill, section, 2, 'בפסקה (1), ', 'בסופה' FROM y WHERE s = 1 UNION ALL SELECT bill, section, 3, 'בפסקה (2), ', 'בסופה' FROM y WHERE s = 1),
gone AS (SELECT bill, section, 1 AS unit, '' AS addr, unnest(['לפי העניין', 'תוך ' || n || ' ' || u]) AS p, generate_subscripts([1, 2], 1) AS pos FROM y WHERE s = 0 UNION ALL SELECT bill, section, 3, 'בפסקה (2), ', 'בשינויים המחויבים', 1 FROM y WHERE s = 1),
lines AS (
  SELECT bill, section, 0 AS t, unit, 'value_change' AS family, 'replace' AS op, old AS anchor, 0 AS pos, j, addr || 'במקום "' || old || '" יבוא "' || new || tail || '".' AS text, '' AS record, budget FROM vals WHERE new > 0
  UNION ALL SELECT bill, section, 0, 1, 'actor_swap', 'replace', actor, 0, row_number() OVER (PARTITION BY section ORDER BY a.id), addr || CASE WHEN (g = 'f') = fem THEN 'במקום "' || actor || '" יבוא "' || a.text ELSE 'במקום "' || actor || ' ' || behind || '" יבוא "' || a.text || ' ' || other END || '".', a.id, false FROM acts, a WHERE a.reason IS NULL AND g IS NOT NULL
  UNION ALL SELECT bill, section, 0, 1, 'approval', 'after', actor, 0, row_number() OVER (PARTITION BY section ORDER BY b.id), addr || 'אחרי "' || actor || '" יבוא "' || b.text || CASE WHEN b.id = 'p3' THEN 'שר הפנים' ELSE '' END || '".', b.id, false FROM acts, b WHERE b.family = 'approval' AND (b.id <> 'p3' OR named AND actor <> 'שר הפנים')
  UNION ALL SELECT bill, section, 0, 1, 'duty', 'replace', verb, 0, 1, addr || 'במקום "' || verb || '" יבוא "' || new || '".', id, false FROM verbs
  UNION ALL SELECT bill, section, 0, unit, 'deletion', 'delete', p, pos, 1, addr || 'המילים "' || p || '" – יימחקו.', '', false FROM gone
  UNION ALL SELECT bill, section, 0, k + 1, 'deletion', 'delete_unit', '(' || k || ')', 9, 1, 'פסקה (' || k || ') – תימחק.', '', false FROM y, (SELECT unnest([1, 2]) AS k) WHERE s = 1
  UNION ALL SELECT bill, section, 0, unit, 'conditions', 'append', '', 0, row_number() OVER (PARTITION BY section, unit ORDER BY b.id), addr || e || ' יבוא "' || b.text || '".', b.id, false FROM leaves, b WHERE b.family = 'conditions'
  UNION ALL SELECT bill, section, 0, 1, 'verb_modifier', 'modify', verb, 0, row_number() OVER (PARTITION BY section ORDER BY b.id), addr || 'במקום "' || verb || '" יבוא "' || verb || ' ' || b.text || '".', b.id, false FROM verbs, b WHERE b.family = 'verb_modifier'
  UNION ALL SELECT bill, l, 1, 0, 'after_last', 'after', r_name, r_regionkey, 1, 'אחרי הסעיף יבוא: "' || r_name || ' ' || (l + 1) || '. תחילתו של חוק זה ביום 1 בינואר 2027"', 'z1/' || r_regionkey, false FROM (SELECT bill, max(section) AS l, list(margin) AS taken FROM y GROUP BY 1), region WHERE NOT coalesce(list_contains(taken, r_regionkey), false)),
f AS (SELECT *, list_position({list(FAMILIES)}, family) AS fi FROM lines),
once AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY bill, text ORDER BY section, t, unit, fi, pos, j) = 1),
pool AS (SELECT *, row_number() OVER (PARTITION BY bill, section, t, unit, fi, op, anchor ORDER BY j)::INT AS depth FROM once)
"""
_COLUMNS = "bill, section, unit, family, op, anchor, depth, text, record, budget"


@query(f"{_POOL} SELECT {_COLUMNS} FROM pool")
def amendment_pool(t: Tables) -> DataFrame:
    """Every line of every family for each bill, said once."""
    return pool(_found(t))


@query(f"{_POOL} SELECT {_COLUMNS} FROM pool QUALIFY row_number() OVER (PARTITION BY bill ORDER BY depth, section, t, unit, fi, pos) <= {BUDGET}")
def amendment_plan(t: Tables) -> DataFrame:
    """Twelve lines a bill, first ones of all points before second ones."""
    return planned(_found(t), BUDGET)


@query("""
SELECT o_orderkey, actor, CASE o_orderkey % 6 WHEN 0 THEN 'm' WHEN 1 THEN 'f' WHEN 2 THEN 'm' WHEN 3 THEN 'f' WHEN 4 THEN 'f' END AS gender
FROM (SELECT o_orderkey, ['שר הפנים', 'הממשלה', 'הרשם', 'ועדת', 'הרשות', 'גוף'][o_orderkey % 6 + 1] || ' ' || o_custkey AS actor FROM orders WHERE o_custkey IS NOT NULL)""")
def actor_genders(t: Tables) -> DataFrame:
    """The gender of an actor's name by the noun that opens it."""
    head = _pick(["שר הפנים", "הממשלה", "הרשם", "ועדת", "הרשות", "גוף"], F.col("o_orderkey") % 6)
    rows = t.orders.where("o_custkey IS NOT NULL").select("o_orderkey", F.concat(head, F.lit(" "), F.col("o_custkey").cast("string")).alias("actor"))
    return rows.withColumn("gender", gender(F.col("actor")))
