"""Families of proposed amendments to a bill: what may be said of each unit by its own words and by approved records.

A bill is a table of units (bill, section, number, margin, unit, kind, labels, text, certain) in document order by section
and unit; the opening of a section has no labels. A point is one place with one action; its lines are alternatives, held as
an array, so that nothing is multiplied out before a plan says how many of them it takes. Records are few by bound
(``MOST_RECORDS``, an error beyond) and reach every task as one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmere.functions.agreement import FORMS, NEGATIONS, NUMBERS, gender, inflect, said, table
from lexmere.functions.numbers import quantities, quantity
from lexmere.functions.shared import DEALT, dealt, stage
from lexmere.functions.spans import anchors, citations

MOST_RECORDS = 10_000

# Families in their order, phrases that may go as they stand, actors, what follows a subject, ministers by
# name, words for units, units of money, larger units, and marks that stand for a minister, a committee and coming years.
FAMILIES = ("value_change", "actor_swap", "approval", "duty", "deletion", "after_last", "conditions", "verb_modifier")
BANK_FAMILIES = ("actor_swap", "approval", "duty", "conditions", "after_last", "verb_modifier")
DELETABLE = ("ובשינויים המחויבים", "בשינויים המחויבים", "כנוסחו בחוק זה", "לפי העניין", "בשינויים המחויבים לפי העניין")
ACTOR = r"שר\s+ה[א-ת]+(?:\s+וה[א-ת]+)?|ראש\s+הממשלה|היועץ\s+המשפטי\s+לממשלה|הממשלה|השר|המנהל\s+הכללי|המנהל|הממונה|הרשם|המפקח|הנגיד|המועצה|הרשות"
AFTER_SUBJECT = r"[יתנא][א-ת]{2,}|רשאי|רשאית|רשאים|חייב|חייבת|ממונה"
NAMED_MINISTER = r"(?<![א-ת])[ובלמכשה]{0,2}(שר\s+ה[א-ת]+(?:\s+וה(?!שר(?![א-ת]))[א-ת]+)?)(?![א-ת])"
THE_MINISTER = r"(?<![א-ת])[ובלמכש]{0,2}השר(?![א-ת])"
DAY_OF_MONTH = r"^\s+ב(?:ינואר|פברואר|מרץ|מרס|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר)(?![א-ת])"
UNIT_WORDS = {"paragraph": "פסקה", "subsection": "סעיף קטן", "subparagraph": "פסקת משנה"}
MONEY, LARGER = ("שקלים",), {"ימים": "שנים", "שבועות": "שנים", "חודשים": "שנים", "שעות": "ימים", "דקות": "שנים"}
MINISTER_MARK, COMMITTEE_MARKS = "{השר}", ("{committee}", "{הוועדה}")
YEAR_MARKS = {"{השנה שאחרי הבאה}": 2, "{השנה הבאה}": 1}
CATEGORIES = ("people", "parties", "media", "groups", "places", "insults")

DIGIT = re.compile("[0-9]")
LETTER = r"[\p{L}\p{N}_]"
VALUES = "struct<masked:string,values:array<struct<text:string,start:int,kind:string>>>"


# --- records -------------------------------------------------------------------------------------------------------------


def without_marks(text: Column, committee: Column, year: int) -> Column:
    """Marks of the committee and of coming years filled in; a vav doubles behind a prefix. No committee: its marks stay."""
    out = text
    for mark in COMMITTEE_MARKS:
        out = F.when(committee.isNotNull(), filled(out, mark, committee)).otherwise(out)
    for mark, later in YEAR_MARKS.items():
        out = F.replace(out, F.lit(mark), F.lit(str(year + later)))
    return out


def filled(template: Column, mark: str, value: Column) -> Column:
    """A template with a value in place of a mark; behind a prefix letter the vav that opens the value is doubled."""
    doubles = value.startswith("ו") & ~value.startswith("וו")
    behind = F.regexp_replace(template, rf"((?:^|(?<=[^א-ת]))[ובלמכשה]{{1,2}})\Q{mark}\E", "$1ו" + mark.replace("{", r"\{"))
    return F.replace(F.when(doubles, behind).otherwise(template), F.lit(mark), value)


def screened(records: DataFrame, verdicts: DataFrame, redlines: dict[str, list[str]]) -> DataFrame:
    """records (id, level, family, template, value, status, gender, approved_by, approved_at, approved_why, approved_phrases)
    with ``reason``, null for those that may be used. In this order: an unknown family, a status other than approved, a
    phrase of the redlines (whole, behind up to two prefix letters) that no full human approval names, no verdict on the
    present wording, a verdict against it without a full human approval. verdicts: id, key, allowed; rows with an id
    that stands twice count as one if any of them allows the present wording."""
    full = F.lit(True)
    for c in ("approved_by", "approved_at", "approved_why"):
        full = full & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    said_as = filled(F.col("template"), "{value}", F.col("value"))
    rules = [F.struct(F.lit(c).alias("category"), F.lit(p).alias("phrase"), F.lit(rf"(?<![א-ת])[ובלמכשה]{{0,2}}\Q{p}\E(?![א-ת])").alias("pattern")) for c in CATEGORIES for p in redlines.get(c, [])]
    red = F.lit(None).cast("string")
    if rules:
        excused = F.when(full, F.coalesce(F.col("approved_phrases"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
        hit = F.get(F.filter(F.array(*rules), lambda r: F.regexp_like(said_as, r["pattern"]) & ~F.array_contains(excused, r["phrase"])), F.lit(0))
        red = F.when(hit.isNotNull(), F.concat(F.lit("redline: "), hit["category"]))
    key = F.substr(F.sha1(F.concat(F.col("template"), F.lit("\x1f"), F.col("value"))), F.lit(1), F.lit(16))
    judged = verdicts.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.max("allowed").alias("__allowed"))
    met = records.withColumn("__mine", key).join(judged, (F.col("id") == F.col("__id")) & (F.col("__mine") == F.col("__key")), "left")
    reason = (
        F.when(~F.coalesce(F.col("family").isin(*BANK_FAMILIES), F.lit(False)), "family")
        .when(F.coalesce(F.col("status"), F.lit("")) != "approved", F.concat(F.lit("status: "), F.coalesce("status", F.lit(""))))
        .when(red.isNotNull(), red)
        .when(F.col("__key").isNull(), "not screened")
        .when(~F.coalesce("__allowed", F.lit(False)) & ~full, "screened out")
    )
    return met.withColumn("reason", reason).drop("__id", "__key", "__allowed", "__mine")


def expanded(records: DataFrame, lists: DataFrame) -> DataFrame:
    """Records that name a list (value_list), as one for each of its items; others as they are. lists: list, item, value,
    gender. A record that names an empty list is none."""
    items = lists.select(F.col("list").alias("value_list"), "item", F.col("value").alias("__value"), F.col("gender").alias("__gender"))
    listed = records.where(F.col("value_list").isNotNull()).join(items, "value_list")
    listed = listed.withColumns({"id": F.concat_ws("/", "id", "item"), "value": F.col("__value"), "gender": F.col("__gender")})
    return records.where(F.col("value_list").isNull()).select(*records.columns).unionByName(listed.select(*records.columns))


def bank(records: DataFrame, year: int, committee: str | None = None) -> DataFrame:
    """Allowed records as one row: for each family its records in order of id, their words filled in. At most
    ``MOST_RECORDS``, checked before anything is gathered; more are an error."""
    n = records.limit(MOST_RECORDS + 1).count()
    if n > MOST_RECORDS:
        raise ValueError(f"a bank has at most {MOST_RECORDS} records")
    text = without_marks(filled(F.col("template"), "{value}", F.col("value")), F.lit(committee), year)
    g = F.coalesce(F.nullif("gender", F.lit("")), gender(text))
    row = F.struct(F.col("id").alias("id"), text.alias("text"), F.col("value").alias("value"), g.alias("gender"))
    of = lambda f: F.array_sort(F.collect_list(F.when((F.col("family") == f) & text.isNotNull(), row))).alias(f)
    return records.agg(*[of(f) for f in BANK_FAMILIES])


# --- units ---------------------------------------------------------------------------------------------------------------


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        masked, values = [], []
        for text in texts:
            text = text or ""
            if not DIGIT.search(text):  # no value, and no year that a citation ends with
                masked.append(text)
                values.append([])
                continue
            cut = text
            for start, end in citations(text):
                cut = cut[:start] + "\0" * (end - start) + cut[end:]
            masked.append(cut)
            values.append([{"text": a.text, "start": a.start, "kind": a.kind} for a in anchors(text) if a.kind in ("number", "gregorian_year") and not a.in_reference and not a.in_citation])
        yield pd.DataFrame({"masked": masked, "values": values})


def scopes(units: DataFrame) -> DataFrame:
    """Units that can be spoken of: those with a text, with their address, whether words can be put at their end, the
    units beside them, the minister that a record's mark stands for, the values that may change, and the text without
    the laws that it cites. Null and empty texts are no scope; equal units stay apart by their place. A minister is the one
    that the section names, else the one that the bill names, else "the minister" if the bill says so; a section that
    names two has none. Units are dealt out by bill once, and one sort serves all windows."""
    units = dealt(units, "bill")
    section = Window.partitionBy(DEALT, "bill", "section")
    after = F.lead("labels").over(section.orderBy("unit"))
    names = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NAMED_MINISTER), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " "))
    distinct = lambda w: F.array_distinct(F.flatten(F.collect_set(F.array_distinct("__names")).over(w)))
    whole = Window.partitionBy(DEALT, "bill")
    placed = (
        units.withColumns({"__names": names, "__n": F.size("labels"), "__after": after})
        .withColumns({"has_units": F.max(F.col("__n") > 0).over(section), "top_units": F.sum(F.when(F.col("__n") == 1, 1).otherwise(0)).over(section)})
        .withColumns({"__mine": distinct(section), "__all": distinct(whole), "__said": F.max(F.coalesce("text", F.lit("")).rlike(THE_MINISTER)).over(whole)})
    )
    inner = (F.size("__after") > F.col("__n")) & (F.slice("__after", 1, F.col("__n")) == F.col("labels"))
    leaf = F.when(F.col("__n") == 0, ~F.col("has_units")).otherwise(~F.coalesce(inner, F.lit(False)))
    named = F.element_at(F.create_map(*[F.lit(x) for p in UNIT_WORDS.items() for x in p]), F.col("kind"))
    kind = F.when(~F.col("has_units"), "section").when(F.col("__n") == 0, "lead").otherwise(F.col("kind"))
    address = F.when(~F.col("has_units"), "").when(F.col("__n") == 0, "ברישה, ").otherwise(F.concat(F.lit("ב"), named, F.lit(" "), F.array_join("labels", ""), F.lit(", ")))
    minister = (
        F.when(F.size("__mine") == 1, F.get("__mine", F.lit(0)))
        .when(F.size("__mine") > 1, F.lit(None))
        .when(F.size("__all") == 1, F.get("__all", F.lit(0)))
        .when(F.col("__said"), "השר")
    )
    out = placed.withColumns({"leaf": leaf, "address": address, "minister": minister}).withColumn("kind", kind)
    read = F.pandas_udf(_read, VALUES)(F.col("text"))
    out = out.where(F.coalesce(F.col("text") != "", F.lit(False))).withColumn("__read", read)
    return out.select("bill", "section", "unit", "number", "kind", "labels", "text", "certain", "leaf", "address", "top_units", "minister", F.col("__read.masked").alias("masked"), F.col("__read.values").alias("values"))


def whole_phrase(phrase: Column) -> Column:
    """The pattern that finds a phrase where no letter or digit stands beside it."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(f"(?<!{LETTER})"), quoted, F.lit(f"(?!{LETTER})"))


def can_anchor(phrase: Column) -> Column:
    """A phrase that can be pointed to: in a text read for certain, there once, outside cited laws, without quotation marks."""
    text, at = F.col("text"), F.instr("text", phrase)
    beside = lambda x: F.coalesce(x.rlike(f"^{LETTER}"), F.lit(False))
    alone = ~F.when(at > 1, beside(F.substr(text, at - 1, F.lit(1)))).otherwise(F.lit(False)) & ~beside(F.substr(text, at + F.length(phrase), F.lit(1)))
    outside = lambda place: F.substr("masked", place, F.length(phrase)) == phrase
    found = (F.regexp_count("text", whole_phrase(phrase)) == 1) & outside(F.regexp_instr(text, whole_phrase(phrase)))
    # A pattern made for a row is needed only where the phrase's letters stand at several places.
    once = F.when(at == 0, F.lit(False)).when(F.position(phrase, text, at + 1) == 0, alone & outside(at)).otherwise(found)
    return F.coalesce(F.col("certain") & (F.trim(phrase) != "") & ~F.contains(phrase, F.lit('"')) & once, F.lit(False))


# --- lines ---------------------------------------------------------------------------------------------------------------


def _quoted(*parts: Column | str) -> Column:
    return F.concat(F.col("address"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _replace(old: Column, new: Column) -> Column:
    return _quoted('במקום "', old, '" יבוא "', new, '".')


def _line(text: Column, record: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit("") if record is None else record).alias("record"))


def _point(rows: DataFrame, family: str, op: str, anchor: Column, own: list[str], lines: Column, pos: Column, budget: Column | None = None, records: DataFrame | None = None, tail: int = 0) -> DataFrame:
    """Points of one family, dealt by bill. Alternatives without a text, or with one that stands before them, go.

    Lines are made of a point's address and anchor, of its own columns, and of the records. So of points that are alike
    in all of these the first one is as good as all: only it gets lines, and only those that no other point alike in
    address and anchor has before it. One sort by place serves both windows; what is dealt and sorted has no lines yet."""
    place = F.struct(F.col("section").cast("long"), F.lit(tail), F.col("unit").cast("long"), F.lit(FAMILIES.index(family)), pos.cast("long")).alias("place")
    money = (F.lit(False) if budget is None else budget).alias("budget")
    made = dealt(rows.select("bill", "section", "unit", anchor.alias("anchor"), "address", place, money, *own), "bill")
    alike = Window.partitionBy(DEALT, "bill", "address", "anchor").orderBy("place")
    before = alike.rowsBetween(Window.unboundedPreceding, -1)
    if own:
        mine = F.struct(*own)
        made = made.withColumn("__met", F.collect_set(mine).over(before)).where(~F.array_contains("__met", mine))
    else:
        made = made.withColumn("__met", F.row_number().over(alike)).where("__met = 1")
    if records is not None:
        made = made.join(F.broadcast(records), "anchor") if "anchor" in records.columns else made.crossJoin(F.broadcast(records))
    texts = lambda xs: F.transform(xs, lambda x: x["text"])
    said = made.withColumn("lines", F.filter(lines, lambda x: x["text"].isNotNull()))
    if own:
        said = said.withColumn("__before", F.flatten(F.collect_list(texts("lines")).over(before)))
        fresh = F.when(F.size("__before") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("__before", x["text"])))
        said = said.withColumn("lines", fresh)
    said = said.where(F.size("lines") > 0)
    once = F.filter("lines", lambda x, i: F.array_position(texts("lines"), x["text"]) == i + 1)
    said = said.withColumn("lines", F.when(F.size(F.array_distinct(texts("lines"))) == F.size("lines"), F.col("lines")).otherwise(once))
    return said.select(DEALT, "bill", "section", "unit", F.lit(family).alias("family"), F.lit(op).alias("op"), "anchor", "place", "budget", "lines")


def value_points(units: DataFrame, level: str) -> DataFrame:
    """Values changed: numbers and years that are no reference, no citation and in no quantity, then quantities, in the
    manner of the level (serious, clever, absurd). A day of a month stays a day that exists."""
    found = units.withColumn("__q", quantities(F.col("text")))
    spans = F.transform("__q", lambda q: F.struct(F.instr("text", q["text"]).alias("s"), F.length(q["text"]).alias("n")))
    free = F.filter("values", lambda a: ~F.exists(spans, lambda s: (s["s"] - 1 < a["start"] + F.length(a["text"])) & (a["start"] < s["s"] - 1 + s["n"])))
    bare = found.select("*", F.posexplode(free).alias("p", "a")).withColumn("n", F.col("a.text").cast("long"))
    bare = bare.where(can_anchor(F.col("a.text")))
    n, anchor = F.col("n"), F.col("anchor")
    numbers = {"serious": (n + 1, n - 1, n + 2, n - 2), "clever": (1, 7, 10, 100), "absurd": (365, 1000, 10_000)}[level]
    years = {"serious": (n + 1, n + 2, n - 1), "clever": (n + 10, 1948), "absurd": (2100, 3000)}[level]
    days = {"serious": (n - 1, n - 2, n - 3), "clever": (1, 15), "absurd": ()}[level]
    told = lambda xs: F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("long") for x in xs]).cast("array<bigint>")
    is_year = F.col("a.kind") == "gregorian_year"
    is_day = ~is_year & F.substr("text", F.col("a.start") + F.length("a.text") + 1).rlike(DAY_OF_MONTH)
    bare = bare.withColumns({"is_year": is_year, "is_day": is_day})
    day_values = F.filter(told(days), lambda v: (v >= 1) & ((v <= 28) | ((v <= 31) & (v < n))) & (v != n))
    other_values = F.filter(F.when(F.col("is_year"), told(years)).otherwise(told(numbers)), lambda v: (v > 0) & (v != n))
    plain_form = F.col("is_day") | F.col("is_year")
    bare_lines = F.transform(F.when(F.col("is_day"), day_values).otherwise(other_values), lambda v: _line(_replace(anchor, F.when(plain_form, v.cast("string")).otherwise(F.format_number(v, 0)))))
    points = _point(bare, "value_change", "replace", F.col("a.text"), ["n", "is_year", "is_day"], bare_lines, F.col("p"))

    q = found.select("*", F.posexplode("__q").alias("p", "q")).where(can_anchor(F.col("q.text"))).withColumns({c: F.col(f"q.{c}") for c in ("value", "digits")}).withColumn("of", F.col("q.unit"))
    v, of = F.col("value"), F.col("of")
    whole = F.lit(None).cast("long")
    levels = {"serious": (v * 2, v * 3, v * 4, F.when((v % 2 == 0) & (v >= 2), F.floor(v / 2)).otherwise(whole)), "clever": (v + 1, v * 10, 7, 1), "absurd": (v * 100, v * 1000)}[level]
    news = F.filter(F.array_distinct(told(levels)), lambda x: x.isNotNull() & (x != v) & (x > 0) & (x < 100_000))
    comma = F.contains("anchor", F.lit(","))
    behind = F.regexp_extract("anchor", r"\s(\S+)$", 1)
    in_digits = lambda x: F.concat(F.when(comma | (x >= 1000), F.format_number(x, 0)).otherwise(x.cast("string")), F.lit(" "), behind)
    formed = F.transform(news, lambda x: _line(_replace(anchor, F.when(F.col("digits"), in_digits(x)).otherwise(quantity(x, of)))))
    points = points.unionByName(_point(q, "value_change", "replace", F.col("q.text"), ["value", "digits", "of"], formed, 1_000_000 + 2 * F.col("p") + 1, of.isin(*MONEY)))
    if level == "absurd":
        larger = F.element_at(F.create_map(*[F.lit(x) for p in LARGER.items() for x in p]), of)
        word = F.regexp_extract("q.text", r"(\S+)$", 1)
        swapped = q.withColumn("larger", larger).where(~F.col("digits") & F.col("larger").isNotNull() & can_anchor(word))
        points = points.unionByName(_point(swapped, "value_change", "replace", word, ["larger"], F.array(_line(_replace(anchor, F.col("larger")))), 1_000_000 + 2 * F.col("p")))
    return points


def deletion_points(units: DataFrame) -> DataFrame:
    """Phrases that may go where four words stay, times with their preposition, and units of sections that have two or more."""
    times = F.transform(quantities(F.col("text")), lambda q: F.when(F.contains("text", F.concat(F.lit("בתוך "), q["text"])), F.concat(F.lit("בתוך "), q["text"])).when(F.contains("text", F.concat(F.lit("תוך "), q["text"])), F.concat(F.lit("תוך "), q["text"])))
    listed = F.filter(F.array(*[F.lit(p) for p in DELETABLE]), lambda p: F.contains("text", p))
    phrases = F.array_distinct(F.concat(listed, F.filter(times, lambda x: x.isNotNull())))
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    rows = units.select("*", F.posexplode(phrases).alias("p", "phrase"))
    rows = rows.where((words(F.col("text")) - words(F.col("phrase")) >= 4) & can_anchor(F.col("phrase")))
    phrase = F.col("anchor")
    line = F.when(words(phrase) == 1, _quoted('המילה "', phrase, '" – תימחק.')).otherwise(_quoted('המילים "', phrase, '" – יימחקו.'))
    gone = units.where((F.size("labels") == 1) & (F.col("top_units") >= 2) & F.col("certain") & F.col("kind").isin("paragraph", "subsection"))
    label = F.get("labels", F.lit(0))
    unit_line = F.concat(F.when(F.col("kind") == "subsection", F.lit("סעיף קטן ")).otherwise("פסקה "), F.col("anchor"), F.when(F.col("kind") == "subsection", " – יימחק.").otherwise(" – תימחק."))
    return _point(rows, "deletion", "delete", F.col("phrase"), [], F.array(_line(line)), F.col("p")).unionByName(_point(gone, "deletion", "delete_unit", label, ["kind"], F.array(_line(unit_line)), F.lit(1_000_000)))


def with_actors(units: DataFrame) -> DataFrame:
    """A row for each actor that is a subject, with the word behind it: an actor's first place with such a word counts."""
    found = F.regexp_extract_all("text", F.lit(rf"(?<![א-ת])(?:{ACTOR})(?![א-ת])(?=\s+(?:{AFTER_SUBJECT})(?![א-ת]))"), F.lit(0))
    rows = units.select("*", F.posexplode(F.array_distinct(found)).alias("p", "actor")).where(can_anchor(F.col("actor")))
    behind = F.get(F.regexp_extract_all("text", F.concat(whole_phrase(F.col("actor")), F.lit(rf"\s+({AFTER_SUBJECT})(?![א-ת])")), F.lit(1)), F.lit(0))
    return rows.withColumn("behind", behind)


def resolved(text: Column, minister: Column) -> Column:
    """A record's text with the minister in place of its mark; null where a mark stays."""
    marked = F.contains(text, F.lit(MINISTER_MARK))
    open_marks = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in COMMITTEE_MARKS])
    return F.when(open_marks, F.lit(None)).when(marked & minister.isNull(), F.lit(None)).otherwise(F.when(marked, F.replace(text, F.lit(MINISTER_MARK), minister)).otherwise(text))


def actor_points(units: DataFrame, records: DataFrame) -> DataFrame:
    """Another actor in an actor's place. One of the other gender takes the verb along, if that has a form for it."""
    rows = with_actors(units)
    rows = rows.withColumn("both", can_anchor(F.concat("actor", F.lit(" "), "behind")))
    actor, behind = F.col("anchor"), F.col("behind")
    mine, both = gender(actor), F.concat(actor, F.lit(" "), behind)
    forms = F.struct(mine.alias("mine"), inflect(behind, F.lit("m")).alias("m"), inflect(behind, F.lit("f")).alias("f"))

    def line(r: Column, own: Column) -> Column:
        new = resolved(r["text"], F.col("minister"))
        other = F.when(r["gender"] == "m", own["m"]).otherwise(own["f"])
        with_verb = F.when(F.col("both") & other.isNotNull(), _replace(both, F.concat(new, F.lit(" "), other)))
        said_so = F.when(r["gender"] == own["mine"], _replace(actor, new)).otherwise(with_verb)
        return _line(F.when((new != actor) & r["gender"].isNotNull() & own["mine"].isNotNull(), said_so), r["id"])

    lines = F.flatten(F.transform(F.array(forms), lambda own: F.transform("actor_swap", lambda r: line(r, own))))  # forms are made once a row
    return _point(rows, "actor_swap", "replace", F.col("actor"), ["minister", "behind", "both"], lines, F.col("p"), records=records.select("actor_swap"))


def approval_points(units: DataFrame, records: DataFrame) -> DataFrame:
    """Approval or advice of others behind an actor, never the actor's own."""
    actor = F.col("anchor")

    def line(r: Column) -> Column:
        text = resolved(r["text"], F.col("minister"))
        return _line(F.when(~F.endswith(text, F.concat(F.lit(" "), actor)) & (r["value"] != actor), _quoted('אחרי "', actor, '" יבוא "', text, '".')), r["id"])

    return _point(with_actors(units), "approval", "after", F.col("actor"), ["minister"], F.transform("approval", line), F.col("p"), records=records.select("approval"))


def any_of(words: list[str]) -> str:
    """The pattern of some words, longest first, that reads what several begin with once."""
    below: dict[str, list[str]] = {}
    for w in words:
        if w:
            below.setdefault(w[0], []).append(w[1:])
    rest = "|".join(re.escape(c) + any_of(ends) for c, ends in below.items())
    return f"(?:{rest})" + ("?" if "" in words else "") if below else ""


def with_verbs(units: DataFrame) -> DataFrame:
    """A row for each verb of the table that can be pointed to and isn't negated nor part of "take into account"."""
    pattern = rf"(?<!{LETTER}){any_of(list(FORMS))}(?!{LETTER})"
    verbs = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = units.select("*", F.explode(verbs).alias("verb")).where(can_anchor(F.col("verb")))
    at = F.regexp_instr(F.col("text"), whole_phrase(F.col("verb")))
    before = F.regexp_extract(F.substr("text", F.lit(1), at - 1), r"(\S+)\s*$", 1)
    rest = F.substr("text", at + F.length("verb"))
    bring = [f for f, parts in FORMS.items() if parts[1] == "להביא"]
    account = F.col("verb").isin(*bring) & F.ltrim(rest).startswith("בחשבון")
    return rows.where(~F.regexp_replace(before, "^[\"'(,]+|[\"'(,]+$", "").isin(*NEGATIONS) & ~account)


def duty_points(units: DataFrame, records: DataFrame) -> DataFrame:
    """Duty for permission and back, by records "form=>form", in every number that both have."""
    parts = lambda k: {form: p[k] for form, p in FORMS.items()}
    pairs = records.select(F.posexplode("duty").alias("p", "r"))
    source, target = F.split_part("r.value", F.lit("=>"), F.lit(1)), F.split_part("r.value", F.lit("=>"), F.lit(2))
    numbers = F.posexplode(F.array(*[F.lit(n) for n in NUMBERS])).alias("k", "number")
    forms = {f"{m}|{i}|{n}": said(m, i, n) for m, i, _ in FORMS.values() for n in NUMBERS}
    form = lambda word: F.element_at(table(forms), F.concat_ws("|", F.element_at(table(parts(0)), word), F.element_at(table(parts(1)), word), F.col("number")))
    known = (F.col("number") != "fpl") | (F.element_at(table(parts(0)), source) != "")
    spread = pairs.select("p", "r", numbers).select("p", "k", F.col("r.id").alias("id"), form(source).alias("verb"), form(target).alias("new"), known.alias("known"))
    spread = spread.where("known AND verb IS NOT NULL AND new IS NOT NULL AND verb <> new")
    by_verb = spread.groupBy("verb").agg(F.array_sort(F.collect_list(F.struct("p", "k", "new", "id"))).alias("news"))  # at most four rows a record
    first = F.get("news", F.lit(0))
    rows = with_verbs(units).join(F.broadcast(by_verb.select("verb", (first["p"] * 4 + first["k"]).alias("at"))), "verb")
    lines = F.transform("news", lambda x: _line(_replace(F.col("anchor"), x["new"]), x["id"]))
    return _point(rows, "duty", "replace", F.col("verb"), [], lines, F.col("at"), records=by_verb.withColumnRenamed("verb", "anchor"))


def modifier_points(units: DataFrame, records: DataFrame) -> DataFrame:
    """Words put behind a verb."""
    order = {f: str(i) for i, f in enumerate(FORMS)}
    place = F.element_at(table(order), F.col("verb")).cast("long")
    lines = F.transform("verb_modifier", lambda r: _line(_replace(F.col("anchor"), F.concat("anchor", F.lit(" "), r["text"])), r["id"]))
    return _point(with_verbs(units), "verb_modifier", "modify", F.col("verb"), [], lines, place, records=records.select("verb_modifier"))


def condition_points(units: DataFrame, records: DataFrame) -> DataFrame:
    """Conditions at the end of units without units below them."""
    feminine = F.col("kind").isin("paragraph", "subparagraph", "lead") & (F.col("address") != "")
    rows = units.where(F.col("leaf") & F.col("certain")).withColumn("end", F.when(feminine, "בסופה").otherwise("בסופו"))
    lines = F.transform("conditions", lambda r: _line(_quoted(F.col("end"), ' יבוא "', resolved(r["text"], F.col("minister")), '".'), r["id"]))
    return _point(rows, "conditions", "append", F.lit(""), ["end", "minister"], lines, F.lit(0), records=records.select("conditions"))


def closing_points(sections: DataFrame, units: DataFrame, records: DataFrame) -> DataFrame:
    """New sections behind a bill's last one, which is read for certain and has a number; none with the margin title of a
    section that the bill has. sections: bill, section, number, margin, certain. Ministers are the whole bill's."""
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    last = sections.groupBy("bill").agg(F.max_by(F.struct("section", "number", "certain"), F.col("section")).alias("l"), F.collect_set(squeezed(F.col("margin"))).alias("taken"))
    named = F.transform(F.regexp_extract_all("text", F.lit(NAMED_MINISTER), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " "))
    whole = units.groupBy("bill").agg(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(named)))).alias("names"), F.max(F.col("text").rlike(THE_MINISTER)).alias("said"))
    rows = last.join(whole, "bill", "left").crossJoin(F.broadcast(records.select("after_last")))
    number = F.regexp_extract(F.col("l.number").cast("string"), r"^(\d+)", 1).try_cast("long")
    rows = rows.where(number.isNotNull() & F.col("l.certain"))
    minister = F.when(F.size("names") == 1, F.get("names", F.lit(0))).when(F.col("said"), "השר")
    told = F.transform("after_last", lambda r: F.struct(r["id"].alias("id"), resolved(r["text"], minister).alias("text")))
    rows = rows.select("bill", F.col("l.section").alias("section"), F.lit(0).alias("unit"), "taken", number.alias("n"), F.posexplode(told).alias("p", "r"))
    margin = F.split_part("r.text", F.lit("|"), F.lit(1))
    body = F.when(F.contains("r.text", F.lit("|")), F.substr("r.text", F.length(margin) + 2)).otherwise("")
    line = F.concat(F.lit('אחרי הסעיף יבוא: "'), F.col("anchor"), F.lit(" "), (F.col("n") + 1).cast("string"), F.lit(". "), F.col("body"), F.lit('"'))
    free = rows.where(F.col("r.text").isNotNull() & ~F.array_contains("taken", squeezed(margin))).withColumns({"address": F.lit(""), "body": body, "id": F.col("r.id")})
    return _point(free, "after_last", "after", margin, ["n", "body", "id"], F.array(_line(line, F.col("id"))), F.col("p"), tail=1)


# --- pool and plan -------------------------------------------------------------------------------------------------------


def points(units: DataFrame, records: DataFrame, level: str = "serious", families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Every point of every bill (bill, section, unit, family, op, anchor, place, budget, lines), lines said once in a bill:
    the first point in document order keeps an instruction that others repeat, and a point with none left is none.

    Instructions of different families, actions, addresses or anchors differ in words, so that only points alike in
    these meet, within their family (``_point``). All points of a bill are in the part that it is dealt to."""
    said_of = stage(scopes(units).drop(DEALT), "scopes")
    records = stage(records, "bank")
    made = {
        "value_change": lambda: value_points(said_of, level),
        "actor_swap": lambda: actor_points(said_of, records),
        "approval": lambda: approval_points(said_of, records),
        "duty": lambda: duty_points(said_of, records),
        "deletion": lambda: deletion_points(said_of),
        "after_last": lambda: closing_points(units.select("bill", "section", "number", "margin", "certain"), said_of, records),
        "conditions": lambda: condition_points(said_of, records),
        "verb_modifier": lambda: modifier_points(said_of, records),
    }
    return reduce(DataFrame.unionByName, [made[f]() for f in FAMILIES if f in families])


def pool(found: DataFrame) -> DataFrame:
    """Every line of every point: a row each (bill, section, unit, family, op, anchor, depth from 1, text, record, budget)."""
    rows = found.select("*", F.posexplode(F.coalesce("lines", F.array())).alias("p", "line"))  # no column by itself: filters made of it would make the lines again
    return rows.select("bill", "section", "unit", "family", "op", "anchor", (F.col("p") + 1).alias("depth"), "line.text", "line.record", "budget")


def planned(found: DataFrame, n: int) -> DataFrame:
    """Up to n lines a bill: a first one of every point in document order, then second ones, and so on; rows as in
    ``pool``. Only the first n points of a bill and n lines of each can be taken; how deep whole rounds go follows from
    their sizes alone, and the rest is taken from the first points that are larger. All windows are within a bill's part."""
    bill = Window.partitionBy(DEALT, "bill")
    first = dealt(found, "bill").withColumn("lines", F.slice("lines", 1, n)).withColumn("turn", F.row_number().over(bill.orderBy("place"))).where(F.col("turn") <= n)
    sized = first.withColumn("size", F.size("lines"))
    # With s whole rounds: the lines of points of up to s, and s of each larger one.
    up = bill.orderBy("size").rangeBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumns({"__lines": F.sum("size").over(up), "__to": F.count(F.lit(1)).over(up), "__all": F.count(F.lit(1)).over(bill)})
    sized = sized.withColumn("__taken", F.col("__lines") + F.col("size") * (F.col("__all") - F.col("__to")))
    fits = F.struct(F.col("size").alias("size"), F.col("__taken").alias("taken"), F.col("__to").alias("to"))
    base = F.max(F.when(F.col("__taken") <= n, fits)).over(bill)  # the largest size of which whole rounds fit
    sized = sized.withColumns({"__base": F.coalesce(base, F.struct(F.lit(0).alias("size"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("to")))})
    larger, left = F.col("__all") - F.col("__base.to"), n - F.col("__base.taken")
    sized = sized.withColumn("rounds", F.when(larger > 0, F.col("__base.size") + F.floor(left / larger)).otherwise(F.col("size"))).withColumn("rest", F.when(larger > 0, left % larger).otherwise(0))
    sized = sized.withColumn("more", F.col("size") > F.col("rounds"))
    turn = F.count_if("more").over(bill.orderBy("place"))
    taken = F.least(F.col("size"), F.col("rounds")) + F.when(F.col("more") & (turn <= F.col("rest")), 1).otherwise(0)
    rows = sized.withColumn("taken", taken.cast("int")).where("taken > 0")
    return pool(rows.withColumn("lines", F.slice("lines", F.lit(1), F.col("taken"))))
