"""Faults that the findings of round 4 name, each on a small table that shows it."""

from __future__ import annotations

import re

import pytest

from lexmere.operators import checks
from lexmere.operators.amending import tree_changes
from lexmere.operators.families import bank, planned, points, pool
from tests.test_checks import found as findings_of
from tests.test_families import records, units


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alike_points_meet_before_they_have_lines(spark):
    """two hundred sections that say the same, under two ministers: lines are made for two of them, and nothing is
    grouped by lines."""
    rows = [r for k in range(200) for r in ((1, k, str(k), None, 1, "lead", [], "הממשלה תתקן", True), (1, k, str(k), None, 2, "paragraph", ["(1)"], "שר הפנים" if k < 100 else "שר הבריאות", True))]
    made = bank(records(spark, ("1", "approval", "באישור {value}", "הרשם"), ("2", "approval", "באישור {value}", "{השר}"), ("3", "approval", "באישור {value}", "הרשם")), 2026)
    found = points(units(spark, *rows), made, families=("approval",))
    got = [(r.section, r.depth, r.text, r.record) for r in pool(found).orderBy("section", "depth").collect()]
    said = 'ברישה, אחרי "הממשלה" יבוא "באישור %s".'
    assert got == [(0, 1, said % "הרשם", "1"), (0, 2, said % "שר הפנים", "2"), (100, 1, said % "שר הבריאות", "2")]
    assert not re.search(r"Aggregate \[[^\]]*lines#", optimized(found))


def test_plans_read_points_once(spark):
    """a plan meets its points in windows, not by a join of two readings, and holds no more than n points of a bill
    with n lines each; ties in size, points that whole rounds use up, and one larger than the rest."""
    schema = "bill long, section long, unit int, family string, op string, anchor string, place struct<section:long,tail:int,unit:long,family:int,pos:long>, budget boolean, lines array<struct<text:string,record:string>>"
    sizes = {1: [1, 1, 3, 3, 9], 2: [5], 3: [1] * 9, 4: [2, 2, 2]}
    rows = spark.createDataFrame([(b, k, 1, "duty", "replace", str(k), (k, 0, 1, 3, 0), False, [(f"{b}/{k}/{j}", "") for j in range(m)]) for b, ms in sizes.items() for k, m in enumerate(ms)], schema)
    for n, want in ((7, {1: [1, 1, 2, 2, 1], 2: [5], 3: [1] * 7, 4: [2, 2, 2]}), (4, {1: [1, 1, 1, 1], 2: [4], 3: [1] * 4, 4: [2, 1, 1]})):
        plan = planned(rows, n)
        got = {b: [0] * len(ms) for b, ms in want.items()}
        for r in plan.collect():
            got[r.bill][r.section] += 1
        assert got == want
        assert "Join" not in optimized(plan)


def test_checks_send_no_table_of_bills_to_all_tasks(spark, monkeypatch):
    """what is found of each bill meets without a broadcast, however small it looks; keys that are null are not there."""
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(checks, "stage", kept)
    line = ("1.", "תיקון סעיף 5", 'בחוק הבנקאות, התשמ"א–1981, בסעיף 5 ואחרי סעיף 6 –', False, ["a", None, "b"])
    got = findings_of(spark, [line], refs=["a", None], sections=[None])
    assert got[1] == ("failed", 1) and got[2] == ("failed", 2)
    assert plans and not any("Broadcast" in plan for plan in plans)


def test_only_changed_units_are_told_where_they_are(spark):
    """units above are looked up for what came and what went, not for all units of both versions."""
    nodes = "law long, id string, parent string, place int, kind string, number string, title string, text string"
    before = [(1, "a", None, 0, "section", "1", "t", ""), (1, "b", "a", 0, "subsection", "(א)", None, "x"), (1, "c", "b", 0, "paragraph", None, None, "y"), (2, "a", None, 0, "section", None, "t", "")]
    after = [*before[:2], (*before[2][:7], "z"), (1, "d", "c", 0, "subparagraph", "(1)", None, "n")]
    versions = spark.createDataFrame(before, nodes), spark.createDataFrame(after, nodes)
    changes = tree_changes(*versions)
    got = {(r.law, r.op, r.id): (r.section, r.section_number, [tuple(x) for x in r.chain], [x.id for x in r.path], r.top) for r in changes.collect()}
    chain = [("subsection", "(א)"), ("paragraph", None)]
    assert got == {
        (1, "text", "c"): ("a", "1", chain, ["a", "b", "c"], True),
        (1, "insert", "d"): ("a", "1", [*chain, ("subparagraph", "(1)")], ["a", "b", "c", "d"], True),
        (2, "delete", "a"): ("a", None, [], ["a"], True),
    }
    assert optimized(changes).count("Join LeftOuter") <= 10  # three for each of the two, and four more
    deep = spark.createDataFrame([*after, (1, "e", "d", 0, "subparagraph", "(1)", None, "n")], nodes)
    with pytest.raises(Exception, match="deeper than expected"):
        tree_changes(versions[0], deep).collect()
