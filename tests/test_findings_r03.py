"""Faults that the findings of round 3 name, each on a small table that shows it."""

from __future__ import annotations

import datetime

import duckdb
from pyspark.sql import functions as F

from lexmere.plans.catalog import ORACLE_SQL, QUERIES


def equals_sql(spark, folder, name, **tables):
    """Writes tables, runs a query over them and compares it with its SQL; returns the rows."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    return rows


def test_seconds_are_the_nearest(spark, tmp_path):
    at = [datetime.datetime(2024, 1, 1, 0, m, s, us) for m, s, us in ((0, 0, 400_000), (10, 0, 400_000), (9, 59, 600_000), (20, 0, 500_000), (20, 1, 500_000), (10, 0, 600_000))]
    events = spark.createDataFrame([(k, 1, t) for k, t in enumerate(at)], "event_id long, user_id long, ts timestamp_ntz")
    equals_sql(spark, tmp_path, "trailing_counts", events=events)


def statutes(spark):
    """Texts whose pieces begin and end with their own numbers, with spaces of other kinds, and with a vertical tab within."""
    texts = [". ".join(f"{k}{k} piece {k}  {k}" for k in range(40)), "a　.  b b.  c\x0bd. " * 12, None, "1. 22. 33 "]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_pieces_lose_spaces_only(spark, tmp_path):
    assert equals_sql(spark, tmp_path, "statute_rows", documents=statutes(spark))


def test_lost_pieces_are_named_whole(spark, tmp_path):
    lost = equals_sql(spark, tmp_path, "statute_losses", documents=statutes(spark))
    assert any("|16|1616 piece 16" in r[3] for r in lost)


def test_titles_of_the_same_words_meet_once(spark, tmp_path):
    names = ["red ring", "ring red", "red bolt", "big red bolt", "ab cd", None, "", "blue"]
    part = spark.range(1, 1001).selectExpr("id AS p_partkey", f"element_at(array({', '.join('NULL' if n is None else repr(n) for n in names)}), cast(pmod(xxhash64(id), 8) + 1 AS int)) AS p_name")
    assert equals_sql(spark, tmp_path, "similar_titles", part=part)
    texts = QUERIES["similar_titles"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in texts  # no two titles meet by themselves


def test_nearest_vectors_by_blocks(spark):
    """Copies, ties, multiples, and vectors that are null, zero, not finite, of another length or hold a null."""
    import random

    from pyspark.sql import Window

    from lexmere.operators.retrieval import cosine, nearest

    draw = random.Random(5)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [2.0, 4.0, 6.0]]
    some = [[draw.uniform(-1, 1) for _ in range(3)] for _ in range(60)] + [[1.0, 2.0, 3.0]] * 40 + odd * 2
    draw.shuffle(some)
    rows = spark.createDataFrame(list(enumerate(some)), "vec_id long, embedding array<float>")
    for queries, kept in ((rows.where("vec_id % 2 = 0"), rows), (rows, rows.where("vec_id < 12")), (rows.limit(0), rows)):
        queries = queries.selectExpr("vec_id AS query_id", "embedding AS e")
        pairs = queries.crossJoin(kept).select("query_id", "vec_id", cosine(F.col("embedding"), F.col("e")).alias("s"))
        w = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
        want = pairs.withColumn("r", F.row_number().over(w)).where("r <= 15").drop("r")
        assert sorted(map(str, nearest(kept, queries, 15).collect())) == sorted(map(str, want.collect()))


def test_trees_move_as_lines_only(spark):
    """F8: units meet where their law's lines were dealt to; nothing else is shuffled by law."""
    plan = QUERIES["tree_edits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "shufflepartitionidpassthrough" in plan


def test_texts_are_read_a_few_at_a_time():
    """of a batch of ten thousand texts a few are Python's strings at a time."""
    import pyarrow as pa

    from lexmere.functions.shared import slices

    batch = pa.RecordBatch.from_pydict({"id": list(range(10_001))})
    parts = list(slices(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == 64 and [x for p in parts for x in p["id"].to_pylist()] == list(range(10_001))


def test_python_hands_on_short_batches(spark):
    """Markup, edits and anchors come out of Python in batches that don't grow with the batch that went in."""
    from lexmere.operators.anchors import text_anchors_of
    from lexmere.operators.edits import edit_kinds
    from lexmere.operators.versions import text_edits
    from lexmere.sources.markup import parse_documents

    rows = spark.range(500).selectExpr("id", "concat('a ', id) AS before", "concat('b ', id) AS after", "concat('7 ', id) AS text").coalesce(1)
    for out in (edit_kinds(rows), text_edits(rows.drop("text")), text_anchors_of(rows), parse_documents(rows.selectExpr("string(id) AS doc_id", "before AS body"))):
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.kind, r.phrase, r.text) for r in edit_kinds(rows).collect()} == {("replace", "a", "b")}
    assert [(r.id, r.op, r.old, r.new, r["at"]) for r in text_edits(rows.drop("text")).orderBy("id").collect()] == [(k, "replace", "a", "b", 0) for k in range(500)]
    assert text_anchors_of(rows).count() == 1000 and parse_documents(rows.selectExpr("string(id) AS doc_id", "before AS body")).count() == 1000


def test_edits_write_nothing_on_their_way(spark, monkeypatch):
    """F16, F17: statuses make no rows of units, and neither result is written before it is asked for."""
    from lexmere.functions import shared
    from lexmere.operators.transforms import edited_laws

    monkeypatch.setattr(shared, "shared_dir", lambda *a: 1 / 0)
    node = "law long, id string, parent string, place int, kind string, number string, title string, text string, status string"
    edit = "law long, edit int, step int, op string, target string, phrase string, text string, number string, title string"
    nodes = spark.createDataFrame([(1, "s1", None, 1, "section", "1", None, "a b", "active"), (2, "s1", None, None, "section", None, None, None, "active")], node)
    edits = spark.createDataFrame([(1, 1, 1, "replace_words", "s1", "b", "c", None, None), (3, 1, 1, "remove_unit", "x", None, None, None, None)], edit)
    after, told = edited_laws(nodes, edits)
    assert sorted((r.law, r.place, r.number, r.text) for r in after.collect()) == [(1, 0, "1", "a c"), (2, 0, None, None)]
    assert sorted(map(tuple, told.collect())) == [(1, 1, True, None), (3, 1, False, "no unit x")]
    assert [f.name for f in told.schema] == ["law", "edit", "ok", "reason"]


def test_phrases_that_overlap_themselves_are_told_apart():
    from lexmere.operators.amending import with_words, word_operation

    assert word_operation("cd cd cd", "cd a") == ("replace", "cd cd cd", "cd a")
    assert with_words("cd cd cd", "replace", "cd cd", "a") is None


def staged(spark):
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_instructions_are_not_written_on_their_way(spark, tmp_path):
    """Orders with lines of all twelve changes, one whose first lines are new, and one without lines."""
    lines = [(1, n, n + 3, n + 5) for n in range(1, 14)] + [(2, n, 7, 9) for n in range(1, 9)] + [(3, n, 2 * n, 3) for n in range(3, 13)]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    orders = spark.createDataFrame([(k, datetime.date(2020, 1, k)) for k in (1, 2, 3, 4)], "o_orderkey long, o_orderdate date")
    before = staged(spark)
    assert any(r[-1] for r in equals_sql(spark, tmp_path, "amending_bill", lineitem=lineitem, orders=orders))
    assert {x.split("-")[1] for x in staged(spark) - before} <= {"moved"}


def test_lines_of_bills_are_made_once(spark):
    """Laws whose lines are cut by the ends of batches; what makes the lines runs once."""
    from lexmere.operators.reading import read_bill

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(law, k, f"{k}.", f"סעיף {k} לחוק העיקרי – בטל.") for law in range(5) for k in range(1, 8)]
    lines = spark.createDataFrame(rows, "law long, line int, number string, text string").selectExpr("*", *[f"cast(null AS string) AS {c}" for c in ("marker", "inner_heading", "inner_number")])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = read_bill(lines.mapInArrow(counted, lines.schema)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.law, r.line, r.op, r.section) for r in got) == [(law, k, "repeal", str(k)) for law in range(5) for k in range(1, 8)]
    assert made.value == len(rows)


def test_citations_are_numbered_where_they_lie(spark):
    """Years that come again, boxes without a name between, no year at first, two laws, and no shuffle."""
    from lexmere.operators.documents import citation_entries

    body = "{{preamble}}נוסח מאוחד: {{box|3|A}}{{box|Y, 1|B}}{{box|2|C}}{{box|Z, 4}}{{box|Z, 5|D}}{{box|Y, 6|E}}{{box|, 7|F}}{{end}}"
    got = citation_entries(spark.createDataFrame([(1, body), (2, body), (3, None), (4, "{{preamble}}{{end}}")], "id long, body string"))
    want = [(0, "", 1, "3", "A"), (1, "Y", 1, "1", "B"), (2, "Y", 2, "2", "C"), (4, "Z", 1, "5", "D"), (5, "Y", 3, "6", "E"), (6, "Y", 4, ", 7", "F")]
    assert sorted((r.id, r.place, r.year, r.ordinal, r.page, r.name) for r in got.collect()) == [(i, *w) for i in (1, 2) for w in want]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_pointed_to_without_patterns_of_their_own(spark):
    """Equal to the pattern of each phrase on random texts with overlaps; alternatives with common beginnings are read once."""
    import random
    import re

    from lexmere.functions.agreement import FORMS
    from lexmere.operators.families import any_of, can_anchor

    r = random.Random(5)
    word = lambda n: "".join(r.choice("אב, 1") for _ in range(r.randint(1, n)))
    rows = [(word(9), word(3), r.random() < 0.9) for _ in range(3000)]
    got = spark.createDataFrame([(t, p, t, c) for t, p, c in rows], "text string, p string, masked string, certain boolean").select("text", "p", "certain", can_anchor(F.col("p")).alias("a")).collect()
    beside = "[^\\W]"
    for x in got:
        places = re.findall(f"(?<!{beside}){re.escape(x.p)}(?!{beside})", x.text)
        assert x.a == (x.certain and x.p.strip(" ") != "" and len(places) == 1), x
    forms, plain = list(FORMS), sorted(FORMS, key=len, reverse=True)
    assert any_of(["ab", "ac", "a"]) == "(?:a(?:b|c)?)"
    for _ in range(2000):
        text = " ".join(r.choice(forms)[: r.randint(1, 20)] for _ in range(4))
        assert re.findall(rf"(?<!\w){any_of(forms)}(?!\w)", text) == re.findall(rf"(?<!\w)(?:{'|'.join(map(re.escape, plain))})(?!\w)", text)
