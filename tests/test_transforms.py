from __future__ import annotations

import copy
import random

from lexmere.operators.transforms import edited_laws

NODES = "law long, id string, parent string, place int, kind string, number string, title string, text string, status string"
EDITS = "law long, edit int, step int, op string, target string, phrase string, text string, number string, title string"
OPS = ["insert_after", "insert_section_after", "first_subsection", "first_paragraph", "replace_words", "delete_words", "words_after", "words_before", "append_words", "title_words", "repeal_section", "remove_unit", "nonsense"]


def random_law(rng, law):
    rows = []
    for s in range(rng.randint(1, 3)):
        rows.append([law, f"s{s}", None, s, "section", str(s), "a b", "", "active"])
        if rng.random() < 0.4:
            rows.append([law, f"s{s}x", f"s{s}", 0, "text", None, None, "a b c", "active"])
        else:
            for k, label in enumerate(["(א)", "(ב)"][: rng.randint(0, 2)]):
                rows.append([law, f"s{s}{k}", f"s{s}", k, "subsection", label, None, rng.choice(["a b c", "a a", ""]), rng.choice(["active"] * 5 + ["repealed"])])
    return rows


def random_edits(rng, law, rows):
    ids = [r[1] for r in rows] + ["none", "1.1", "2.1"]
    out = []
    for edit in range(1, rng.randint(2, 7)):
        for step in range(1, rng.randint(2, 4)):
            out.append((law, edit, step, rng.choice(OPS), rng.choice(ids), rng.choice(["a", "b", "c", "zz", None, "b c"]), rng.choice(["new", "a", None]), rng.choice(["(א)", "(א1)", "(ג)", "7", None]), rng.choice([None, "t"])))
    return out


def step_on(tree, e):
    """One step on a list of units in order (parents anywhere before or after); None if it's refused."""
    _, edit, step, op, target, phrase, text, number, title = e
    unit = {u["id"]: u for u in tree}

    def gone(u):
        return u["status"] == "repealed" or (u["parent"] is not None and gone(unit[u["parent"]]))

    u = unit.get(target)
    if u is None or gone(u):
        return None
    new = {"id": f"{edit}.{step}", "number": number, "title": None, "text": text or "", "status": "active"}
    brothers = lambda p: [x for x in tree if x["parent"] == p and x["status"] != "repealed"]

    def insert(x, behind):
        if x["id"] in {y["id"] for y in tree} or (x["number"] and x["number"] in [b["number"] for b in brothers(x["parent"])]):
            return None
        at = len(tree) if behind is None else tree.index(behind) + 1
        tree.insert(at, x)
        return tree

    if op in ("insert_after", "insert_section_after"):
        if (u["kind"] == "section") != (op == "insert_section_after"):
            return None
        return insert({**new, "parent": u["parent"], "kind": u["kind"], "title": title}, u)
    if op == "first_subsection":
        held = brothers(target)
        if u["kind"] != "section" or len(held) != 1 or held[0]["number"]:
            return None
        held[0]["number"], held[0]["kind"] = "(א)", "subsection"
        return insert({**new, "parent": target, "kind": "subsection", "number": "(ב)"}, held[0])
    if op == "first_paragraph":
        if u["kind"] != "subsection" or brothers(target) or not u["text"]:
            return None
        one, u["text"] = u["text"], ""
        return insert({**new, "id": new["id"] + ".1", "parent": target, "kind": "paragraph", "number": "(1)", "text": one}, None) and insert({**new, "parent": target, "kind": "paragraph", "number": "(2)"}, None)
    if op in ("repeal_section", "remove_unit"):
        if (u["kind"] == "section") != (op == "repeal_section"):
            return None
        u["status"] = "repealed"
        return tree
    name = "title" if op == "title_words" else "text"
    if name == "title" and u["kind"] != "section":
        return None
    old, text = u[name] or "", text or ""
    if op == "append_words":
        u[name] = (old + " " + text) if old else text
        return tree
    if not phrase or len(old.split(phrase)) != 2 or op not in OPS[:-1]:
        return None
    head, tail = old.split(phrase)
    if op == "delete_words":
        u[name] = head + tail[1:] if tail[:1] == " " else head[:-1] + tail if head[-1:] == " " else head + tail
    else:
        u[name] = head + {"words_after": f"{phrase} {text}", "words_before": f"{text} {phrase}"}.get(op, text) + tail
    return tree


def replayed(rows, edits):
    tree = [dict(zip(("law", "id", "parent", "place", "kind", "number", "title", "text", "status"), r)) for r in sorted(rows, key=lambda r: (r[3], r[1]))]
    status = {}
    for edit in sorted({e[1] for e in edits}):
        trial = copy.deepcopy(tree)
        for e in sorted((e for e in edits if e[1] == edit), key=lambda e: e[2]):
            trial = step_on(trial, e)
            if trial is None:
                break
        status[edit] = trial is not None
        tree = tree if trial is None else trial
    count, units = {}, {}
    for u in tree:
        place = count[u["parent"]] = count.get(u["parent"], -1) + 1
        units[u["id"]] = (u["parent"], place, u["kind"], u["number"], u["title"], u["text"], u["status"])
    return units, status


def test_against_replay_with_copies(spark):
    rng = random.Random(11)
    laws = {law: random_law(rng, law) for law in range(400)}
    edits = {law: random_edits(rng, law, rows) for law, rows in laws.items()}
    nodes = spark.createDataFrame([tuple(r) for rows in laws.values() for r in rows], NODES).repartition(3)
    after, statuses = edited_laws(nodes, spark.createDataFrame([e for x in edits.values() for e in x], EDITS).repartition(3), rows_each=200)
    got, told = {}, {}
    for r in after.collect():
        got.setdefault(r.law, {})[r.id] = tuple(r)[2:]
    for r in statuses.collect():
        assert (r.reason is None) == r.ok
        told.setdefault(r.law, {})[r.edit] = r.ok
    done = set()
    for law, rows in laws.items():
        units, status = replayed(rows, edits[law])
        assert got[law] == units and told[law] == status
        done |= {e[3] for e in edits[law] if status[e[1]]}
    assert done == set(OPS[:-1])


def test_a_refused_edit_leaves_nothing(spark):
    nodes = spark.createDataFrame([(1, "s", None, 0, "section", "1", "a", "", "active"), (1, "t", "s", 0, "subsection", "(א)", None, "x", "active")], NODES)
    edits = [(1, 1, 1, "insert_after", "t", None, "n", "(ב)", None), (1, 1, 2, "replace_words", "t", "zz", "y", None, None), (1, 2, 1, "insert_after", "t", None, "n", "(ב)", None), (7, 1, 1, "remove_unit", "t", None, None, None, None)]
    after, statuses = edited_laws(nodes, spark.createDataFrame(edits, EDITS))
    assert sorted(map(tuple, statuses.collect())) == [(1, 1, False, "the phrase stands 0 times"), (1, 2, True, None), (7, 1, False, "no unit t")]
    assert sorted(r.id for r in after.collect()) == ["2.1", "s", "t"]
    same, none = edited_laws(nodes, spark.createDataFrame([], EDITS))
    assert same.count() == 2 and none.count() == 0
