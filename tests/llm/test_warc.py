from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest

from lexmere.llm import warc
from lexmere.llm.common import shared_dir

BODY = "<html>" + "x" * 200 + "</html>"
NASTY = "head\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 120 + "\r\n\r\n"
PAGES = [
    (5, "http://b/", BODY),
    (3, "http://a/", BODY),
    (9, "http://c/", BODY),
    (1, "http://d/", "short"),
    (2, "http://e/", "short"),
    (4, None, None),
    (6, "http://f/", ""),
    (7, "http://g/ x\r\nX: y", NASTY),
    (8, "http://h/", NASTY[:-1]),
    (10, "http://i/", NASTY[:-2]),
    (10, "http://i/", NASTY[:-2]),
    (11, "http://j/", "short"),
    (11, "http://j/", "short"),
    (12, "http://k/", "\u20ac" * 40),
    (13, "http://l/", "z" * 3_000_000 + "\r\n"),
    (None, "http://m/", BODY),
]


def expected(pages):
    first = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out, done = [], set()
    for i, _, html in pages:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and (first.get(html) != i or (i, html) in done)
        done.add((i, html))
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = shared_dir(spark, "warc-test")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    got = sorted((tuple(r) for r in warc.resolve_revisits(records).collect()), key=str)
    assert got == expected(PAGES)
    kept = {r.payload.decode() for r in records.where("record_type = 'response'").collect()}
    assert kept == {h or "" for _, _, h in PAGES}
    ids = [r.record_id for r in records.collect()]
    assert len(set(ids)) == len(ids) == len(PAGES)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file:")).rglob("*.txt.gz"))
    assert whole.count(b"WARC-Record-ID: ") == len(PAGES) and b"\r\nX: y\r\n" not in whole


def test_empty(spark):
    path = shared_dir(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolve_revisits(warc.read_archives(spark, path)).count() == 0


def test_damage_is_found(spark):
    records = [("<u:1>", "response", "1", None, "00", 1, None, b"x")]
    with pytest.raises(Exception, match="differs from its digest"):
        warc.resolve_revisits(spark.createDataFrame(records, warc.RECORDS)).collect()
