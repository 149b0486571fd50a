"""Statute markup to typed rows.

A document is read line by line. A line holds template calls, ``{{name|argument|...}}``, which may go on over several
lines; containers and sections open a level that lasts until one of the same or a higher level opens. Rows come out
flat, with their parent and place, one parser call for each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.functions.shared import slices

# Template names of the markup and the level that each opens.
LEVELS = {"part": 1, "chapter": 2, "division": 3, "subdivision": 4, "section": 5}
CONTENT = "text"
SKIPPED = {"preamble", "signatures", "introduction"}
SCHEMA = "doc_id string, id string, parent string, place long, depth int, kind string, number string, title string, text string, note string, normative boolean"
NAME = re.compile(r"\s*([\w-]+?)(\d*)\s*$")


def calls(text: str) -> Iterator[tuple[str, list[str]]]:
    """Top-level template calls (name, arguments) and plain lines ("", [line]), in order; braces must balance."""
    at = 0
    while at < len(text):
        start = text.find("{{", at)
        for line in text[at : start if start >= 0 else len(text)].split("\n"):
            if line.strip():
                yield "", [line.strip()]
        if start < 0:
            return
        depth, i, cut, args = 0, start, start + 2, []
        while i < len(text):
            two = text[i : i + 2]
            if two == "{{":
                depth += 1
                i += 2
            elif two == "}}":
                depth -= 1
                i += 2
                if not depth:
                    break
            else:
                if text[i] == "|" and depth == 1:
                    args.append(text[cut:i])
                    cut = i + 1
                i += 1
        if depth:
            raise ValueError("a template call doesn't end")
        args.append(text[cut : i - 2])
        yield args[0].strip(), [a.strip() for a in args[1:]]
        at = i


def flat(text: str) -> str:
    """The readable text of inner calls: their last argument."""
    inner = re.compile(r"\{\{[^{}]*\}\}")
    while m := inner.search(text):
        text = text[: m.start()] + m[0][2:-2].split("|")[-1] + text[m.end() :]
    return re.sub(r"<[^>]+>", "", text).strip()


def parse(doc_id: str, text: str) -> list[tuple]:
    """The rows of one document, its root first."""
    rows = [(doc_id, doc_id, None, 0, 0, "law", "", "", "", "", False)]
    stack: list[tuple[float, str]] = [(0, doc_id)]
    used: dict[str, int] = {}
    skipping = False

    def add(level: float, kind: str, number: str, title: str, body: str, note: str, normative: bool) -> None:
        while stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][1]
        local = f"{parent}/{kind}-{number or hashlib.sha1(body.encode()).hexdigest()[:8]}"
        used[local] = used.get(local, 0) + 1
        own = local if used[local] == 1 else f"{local}~{used[local]}"
        rows.append((doc_id, own, parent, len(rows), len(stack), kind, number, title, body, note, normative))
        stack.append((level, own))

    for name, args in calls(text):
        base, digits = NAME.match(name).groups() if name and NAME.match(name) else ("", "")
        if base in SKIPPED:
            skipping = True
        elif base == "end":
            skipping = False
        elif skipping:
            continue
        elif base in LEVELS:
            args = [*args, "", "", ""]
            add(LEVELS[base], base, flat(args[0]), flat(args[1]), "", "|".join(a for a in args[2:] if a), True)
        elif base == CONTENT:
            args = ["", *args] if len(args) == 1 else [*args, ""]
            add(LEVELS["section"] + int(digits or 1), "paragraph", flat(args[0]), "", flat(args[1]), "", True)
        elif base == "note":
            add(99, "note", "", "", flat("|".join(args)), "", False)
        elif not name:
            add(99, "raw_block" if args[0].startswith("<") else "line", "", "", flat(args[0]), "", not args[0].startswith("<"))
    return rows


def parse_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id string, body): the rows of all documents. A document that can't be parsed gives one row of kind
    "error" with the reason, and none of its other rows."""

    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = [(name, types[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            out = []
            for doc_id, body in zip(*(c.to_pylist() for c in part.columns)):
                try:
                    out += parse(doc_id, body or "")
                except ValueError as e:
                    out.append((doc_id, doc_id, None, 0, 0, "error", "", "", str(e), "", False))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])

    return docs.select("doc_id", "body").mapInArrow(each, SCHEMA)


def sanity_checks(rows: DataFrame) -> DataFrame:
    """(doc_id, problem) of documents that must not be loaded: unparsed, without normative content, repeated ids."""
    bad = rows.where("kind = 'error'").select("doc_id", F.concat(F.lit("not parsed: "), "text").alias("problem"))
    empty = rows.groupBy("doc_id").agg(F.bool_or("normative").alias("any")).where("not any").select("doc_id", F.lit("no normative content").alias("problem"))
    twice = rows.groupBy("doc_id", "id").count().where("count > 1").select("doc_id", F.concat(F.lit("repeated id "), "id").alias("problem"))
    return bad.unionByName(empty).unionByName(twice)
