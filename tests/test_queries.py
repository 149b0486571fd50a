"""Every query with SQL against DuckDB on the smallest tables, and the others on their shape."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest

from lexmere.plans.catalog import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6f}".rstrip("0").rstrip(".")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, SF_DIR)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    rows = sorted(tuple(map(plain, r)) for r in got.collect())
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_rate_limit_against_brute_force(spark):
    from lexmere.plans.registry import Tables

    rows = Tables(spark, SF_DIR).events.selectExpr("event_id", "user_id", "unix_seconds(cast(ts as timestamp)) as at").collect()
    want, taken = {}, {}
    for event_id, user, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        mine = taken.setdefault(user, [])
        ok = sum(x > at - 86_400 for x in mine) < 10 and sum(x > at - 600 for x in mine) < 3
        want[event_id] = ok
        if ok:
            mine.append(at)
    got = {r.event_id: r.accepted for r in QUERIES["stateful_rate_limit"](spark, SF_DIR).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
