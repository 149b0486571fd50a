"""Edits of law trees, each applied whole or not at all and with a status of its own.

Twelve operations change a law's tree in order. What an edit's steps change is noted down with how it was before, so that
a step that fails takes back its own edit and nothing else; later edits see the tree as if it had never been there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.operators.amending import VERSIONS, order_versions
from lexmere.plans.registry import Tables, query

NODE = ("parent", "place", "kind", "number", "title", "text", "status")
EDIT = ("edit", "step", "op", "target", "phrase", "text", "number", "title")
REPEALED = "repealed"
#: The labels that the first two units of a kind get.
FIRST_LABELS = {"subsection": ("(א)", "(ב)"), "paragraph": ("(1)", "(2)")}


class Refused(ValueError):
    """A step that doesn't apply."""


class Tree:
    """One law's units, with a log of what the edit under way has changed."""

    def __init__(self, rows: list[dict]):
        self.unit = {r["id"]: dict(r) for r in rows}
        self.below: dict[str | None, list[str]] = {None: []}
        for r in rows:
            self.below.setdefault(r["parent"], []).append(r["id"])
        self.log: list[tuple] = []

    def put(self, at: str, name: str, value: str | None) -> None:
        self.log.append((at, name, self.unit[at][name]))
        self.unit[at][name] = value

    def add(self, unit: dict, place: int) -> None:
        if unit["id"] in self.unit:
            raise Refused(f"there is a unit {unit['id']} already")
        taken = {self.unit[k]["number"] for k in self.below.get(unit["parent"], []) if self.unit[k]["status"] != REPEALED}
        if unit["number"] and unit["number"] in taken:
            raise Refused(f"the label {unit['number']} is taken")
        self.unit[unit["id"]] = unit
        self.below.setdefault(unit["parent"], []).insert(place, unit["id"])
        self.log.append((unit["id"], None, None))

    def take_back(self) -> None:
        while self.log:
            at, name, value = self.log.pop()
            if name is not None:
                self.unit[at][name] = value
            else:
                self.below[self.unit.pop(at)["parent"]].remove(at)

    def find(self, at: str, *kinds: str) -> dict:
        """The unit, of one of the kinds if any are given; neither it nor one above it may be repealed."""
        unit = self.unit.get(at)
        if unit is None:
            raise Refused(f"no unit {at}")
        up = unit
        while up:
            if up["status"] == REPEALED:
                raise Refused(f"{up['id']} is repealed")
            up = self.unit.get(up["parent"])
        if kinds and unit["kind"] not in kinds:
            raise Refused(f"{at} is a {unit['kind']}")
        return unit

    def live(self, at: str | None) -> list[dict]:
        return [self.unit[k] for k in self.below.get(at, []) if self.unit[k]["status"] != REPEALED]

    def apply(self, e: dict) -> None:
        """One step. New units are called after their edit and step."""
        op, new = e["op"], {"id": f"{e['edit']}.{e['step']}", "number": e["number"], "title": None, "text": e["text"] or "", "status": "active"}
        if op in ("insert_after", "insert_section_after"):
            unit = self.find(e["target"], *["section"] * (op == "insert_section_after"))
            if op == "insert_after" and unit["kind"] == "section":
                raise Refused(f"{unit['id']} is a section")
            place = self.below[unit["parent"]].index(unit["id"]) + 1
            self.add(new | {"parent": unit["parent"], "kind": unit["kind"], "title": e["title"]}, place)
        elif op == "first_subsection":
            section = self.find(e["target"], "section")
            held = self.live(section["id"])
            if len(held) != 1 or held[0]["number"]:
                raise Refused(f"{section['id']} holds more than one text without label")
            first, second = FIRST_LABELS["subsection"]
            self.put(held[0]["id"], "number", first)
            self.put(held[0]["id"], "kind", "subsection")
            self.add(new | {"parent": section["id"], "kind": "subsection", "number": second}, self.below[section["id"]].index(held[0]["id"]) + 1)
        elif op == "first_paragraph":
            unit = self.find(e["target"], "subsection")
            if self.live(unit["id"]) or not unit["text"]:
                raise Refused(f"{unit['id']} has paragraphs already, or no text")
            first, second = FIRST_LABELS["paragraph"]
            one = {**new, "id": f"{new['id']}.1", "parent": unit["id"], "kind": "paragraph", "number": first, "text": unit["text"]}
            self.put(unit["id"], "text", "")
            self.add(one, len(self.below.get(unit["id"], [])))
            self.add(new | {"parent": unit["id"], "kind": "paragraph", "number": second}, len(self.below[unit["id"]]))
        elif op == "repeal_section":
            self.put(self.find(e["target"], "section")["id"], "status", REPEALED)
        elif op == "remove_unit":
            unit = self.find(e["target"])
            if unit["kind"] == "section":
                raise Refused(f"{unit['id']} is a section")
            self.put(unit["id"], "status", REPEALED)
        else:
            self.words(op, e)

    def words(self, op: str, e: dict) -> None:
        name = "title" if op == "title_words" else "text"
        unit = self.find(e["target"], *["section"] * (name == "title"))
        old, phrase, text = unit[name] or "", e["phrase"] or "", e["text"] or ""
        if op == "append_words":
            new = f"{old} {text}" if old else text
        else:
            if not phrase or old.count(phrase) != 1:
                raise Refused(f"the phrase stands {old.count(phrase) if phrase else 0} times")
            i, j = old.index(phrase), old.index(phrase) + len(phrase)
            if op == "delete_words":
                if old[j : j + 1] == " ":
                    j += 1
                elif old[i - 1 : i] == " ":
                    i -= 1
                new = old[:i] + old[j:]
            elif op in ("replace_words", "title_words"):
                new = old[:i] + text + old[j:]
            elif op in ("words_after", "words_before"):
                new = f"{old[:j]} {text}{old[j:]}" if op == "words_after" else f"{old[:i]}{text} {old[i:]}"
            else:
                raise Refused(f"no operation {op}")
        self.put(unit["id"], name, new)

    def edited(self, edits: list[dict]) -> list[tuple[int, bool, str | None]]:
        """(edit, ok, reason) of each edit; steps in order, the steps of an edit together."""
        by_edit: dict[int, list[dict]] = {}
        for e in edits:
            by_edit.setdefault(e["edit"], []).append(e)
        out = []
        for number in sorted(by_edit):
            self.log = []
            try:
                for e in sorted(by_edit[number], key=lambda e: e["step"]):
                    self.apply(e)
                out.append((number, True, None))
            except Refused as e:
                self.take_back()
                out.append((number, False, str(e)))
        return out


def edited_laws(nodes: DataFrame, edits: DataFrame, rows_each: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """nodes (law, id, parent, place, kind, number, title, text, status) after edits (law, edit, step, op, target, phrase,
    text, number, title), and the status (law, edit, ok, reason) of each edit.

    Operations: insert_after, insert_section_after, first_subsection (the one text of a section gets a label, and a
    neighbour), first_paragraph (a subsection's text becomes its first paragraph, with a second), replace_words,
    delete_words, words_after, words_before, append_words, title_words, repeal_section, remove_unit. Phrases must stand
    once; units that are repealed, or under one that is, can't be changed; labels must be free among those in force. Edits go by
    number, their steps by step; places are counted anew from 0. Edits of laws that aren't there are refused. Laws are dealt
    to tasks by hash, many to each; a law with its edits is one tree in one task. Each of the two results does only its own
    part: neither is written, and statuses make no rows of units.
    """
    kinds = dict(nodes.dtypes)

    def trees(rows: pa.Table, todo: pa.Table) -> Iterator[tuple[object, Tree, list[tuple[int, bool, str | None]]]]:
        laws: dict = {}
        for r in rows.sort_by([("place", "ascending"), ("id", "ascending")]).to_pylist():
            laws.setdefault(r["law"], ([], []))[0].append(r)
        for e in todo.to_pylist():
            laws.setdefault(e["law"], ([], []))[1].append(e)
        while laws:
            law, (units, wanted) = laws.popitem()
            tree = Tree(units)
            yield law, tree, tree.edited(wanted)

    def units(rows: pa.Table, todo: pa.Table) -> pa.Table:
        out = [(law, i, parent, k, *[tree.unit[i][c] for c in NODE[2:]]) for law, tree, _ in trees(rows, todo) for parent, ids in tree.below.items() for k, i in enumerate(ids)]
        return made(out, [rows.schema.field("law").type, pa.string(), pa.string(), pa.int32(), *[pa.string()] * 5], ["law", "id", *NODE])

    def statuses(rows: pa.Table, todo: pa.Table) -> pa.Table:
        out = [(law, *status) for law, _, told in trees(rows, todo) for status in told]
        return made(out, [rows.schema.field("law").type, pa.int32(), pa.bool_(), pa.string()], ["law", "edit", "ok", "reason"])

    def made(out: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

    def dealt(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return df.select("law", *columns).withColumn("bucket", F.pmod(F.xxhash64("law"), F.lit(buckets)))

    buckets = max(8, -(-nodes.count() // rows_each))
    both = dealt(nodes, ("id", *NODE)).groupBy("bucket").cogroup(dealt(edits, EDIT).groupBy("bucket"))
    after = both.applyInArrow(units, f"law {kinds['law']}, id string, parent string, place int, kind string, number string, title string, text string, status string")
    return after, both.applyInArrow(statuses, f"law {kinds['law']}, edit int, ok boolean, reason string")


def order_edits(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The earlier version of order_versions, and an edit of one or two steps for most sections."""
    before, _, _ = order_versions(t)
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("edit")).agg(F.min("l_partkey").alias("p")).withColumn("m", (F.col("law") * 7 + F.col("edit") * 3) % 12)
    s = s.where("m not in (6, 9)")
    own, p, none = F.concat(F.lit("s"), F.col("edit").cast("string")), F.col("p").cast("string"), F.lit(None).cast("string")

    def step(k: int, m: int, op: str, target: Column | str, phrase: Column = none, text: Column = none, number: Column = none) -> Column:
        at = F.concat(own, F.lit(target)) if isinstance(target, str) else target
        row = F.struct(F.lit(k).alias("step"), F.lit(op).alias("op"), at.alias("target"), phrase.alias("phrase"), text.alias("text"), number.alias("number"), none.alias("title"))
        return F.when(F.col("m") == m, row)

    steps = F.array(
        step(1, 0, "replace_words", "a", F.concat(F.lit("p"), p), F.concat(F.lit("q"), p)),
        step(1, 1, "append_words", "a", text=F.lit("ועוד")),
        step(2, 1, "delete_words", "a", F.lit("אין")),
        step(1, 2, "insert_after", "a", text=F.lit("חדש"), number=F.lit("(א1)")),
        step(1, 3, "remove_unit", "b"),
        step(1, 4, "title_words", "", F.lit("א"), F.lit("ב")),
        step(1, 5, "repeal_section", ""),
        step(1, 7, "insert_after", F.lit("none"), text=F.lit("חדש"), number=F.lit("(ג)")),
        step(1, 8, "words_after", "a", F.lit("אל"), F.lit("כבר")),
        step(2, 8, "first_paragraph", "b", text=F.lit("שנייה")),
        step(1, 10, "repeal_section", ""),
        step(2, 10, "append_words", "a", text=F.lit("ועוד")),
        step(1, 11, "insert_section_after", "", text=F.lit("סעיף חדש"), number=F.concat(F.col("edit").cast("string"), F.lit("א"))),
    )
    edits = s.select("law", "edit", F.explode(F.array_compact(steps)).alias("x")).select("law", "edit", "x.*")
    return before.withColumn("status", F.lit("active")), edits


@query(VERSIONS + """
e AS (SELECT law, n AS edit, m FROM s WHERE m NOT IN (6, 9))
SELECT law, edit, m NOT IN (1, 7, 10) AS ok, CASE m WHEN 1 THEN 'the phrase stands 0 times' WHEN 7 THEN 'no unit none' WHEN 10 THEN 's' || edit || ' is repealed' END AS reason FROM e""")
def edit_statuses(t: Tables) -> DataFrame:
    return edited_laws(*order_edits(t))[1]


@query(VERSIONS + """
x AS (SELECT *, 's' || n AS own, 'יימסר p' || p || ' אל s' || s AS given FROM s WHERE m NOT IN (6, 9)),
u AS (
  SELECT law, own AS id, NULL AS parent, n * 2 AS pos, 'section' AS kind, n::VARCHAR AS number, CASE WHEN m = 4 THEN 'כותרת ב' ELSE 'כותרת א' END AS title, '' AS text, CASE WHEN m = 5 THEN 'repealed' ELSE 'active' END AS status FROM x
  UNION ALL SELECT law, n || '.1', NULL, n * 2 + 1, 'section', n || 'א', NULL, 'סעיף חדש', 'active' FROM x WHERE m = 11
  UNION ALL SELECT law, own || 'a', own, 1, 'subsection', '(א)', NULL, CASE m WHEN 0 THEN 'יימסר q' || p || ' אל s' || s WHEN 8 THEN 'יימסר p' || p || ' אל כבר s' || s ELSE given END, 'active' FROM x
  UNION ALL SELECT law, n || '.1', own, 2, 'subsection', '(א1)', NULL, 'חדש', 'active' FROM x WHERE m = 2
  UNION ALL SELECT law, own || 'b', own, 3, 'subsection', '(ב)', NULL, CASE WHEN m = 8 THEN '' ELSE 'דבר s' || s END, CASE WHEN m = 3 THEN 'repealed' ELSE 'active' END FROM x
  UNION ALL SELECT law, n || '.2.1', own || 'b', 1, 'paragraph', '(1)', NULL, 'דבר s' || s, 'active' FROM x WHERE m = 8
  UNION ALL SELECT law, n || '.2', own || 'b', 2, 'paragraph', '(2)', NULL, 'שנייה', 'active' FROM x WHERE m = 8)
SELECT law, id, parent, (row_number() OVER (PARTITION BY law, parent ORDER BY pos) - 1)::INTEGER AS place, kind, number, title, text, status FROM u""")
def edited_nodes(t: Tables) -> DataFrame:
    return edited_laws(*order_edits(t))[0]
