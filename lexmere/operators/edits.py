"""Single edits of a text as drafting instructions, and stores of versions that such edits lead to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmere.functions.shared import slices
from lexmere.plans.registry import Tables, query

#: What separates words in drafting; each stands as a token of its own.
SEPARATORS = " \t\n\r.,;:"
_TOKENS = re.compile(f"[^{SEPARATORS}]+|[{SEPARATORS}]")
EDIT = ("kind", "phrase", "text")


def _grown(tokens: list[str], whole: str, i: int, j: int, left: bool, right: bool) -> tuple[int, int] | None:
    """The shortest run around tokens i to j, grown a word at a time to the sides given, that stands once in the text."""
    while True:
        run = "".join(tokens[i:j])
        if run.strip() and whole.find(run) == whole.rfind(run):
            return i, j
        i2 = max((k for k in range(i) if tokens[k] not in SEPARATORS), default=i) if left else i
        j2 = min((k + 1 for k in range(j, len(tokens)) if tokens[k] not in SEPARATORS), default=j) if right else j
        if (i2, j2) == (i, j):
            return None
        i, j = i2, j2


def edited(before: str, kind: str, phrase: str | None, text: str | None) -> str:
    """The text after an edit: append puts text behind the last word, in front of marks that end the text; delete takes a
    blank next to the phrase with it."""
    if kind == "append":
        end = len(before.rstrip(SEPARATORS))
        return before[:end] + (text or "") + before[end:]
    i = before.index(phrase)
    j = i + len(phrase)
    if kind == "delete":
        return before[:i] + before[j + 1 :] if before[j : j + 1].isspace() else before[: max(0, i - before[i - 1 : i].isspace())] + before[j:]
    return before[:i] + {"insert_before": text + phrase, "insert_after": phrase + text, "replace": text}[kind] + before[j:]


def edit_kind(before: str, after: str) -> tuple[str, str | None, str | None]:
    """(kind, phrase, text) of the one place in which two texts differ, told by whole words; edited leads to the text after.

    insert_before and insert_after: text goes to that side of the phrase; append: text goes behind the last word;
    delete: the phrase goes; replace: text takes the phrase's place. The phrase stands once in the text before. Texts that
    don't differ, and edits that no such phrase describes, are unsupported. An edit within a word replaces the word.
    """
    b, a = _TOKENS.findall(before), _TOKENS.findall(after)
    p = next((i for i, (x, y) in enumerate(zip(b, a)) if x != y), min(len(a), len(b)))
    q = next((i for i, (x, y) in enumerate(zip(b[p:][::-1], a[p:][::-1])) if x != y), min(len(a), len(b)) - p)
    end, added = len(b) - q, "".join(a[p : len(a) - q])
    word = lambda x: x not in SEPARATORS

    def tries():
        if p == end and not any(map(word, b[:p])):
            at = next((k for k in range(p, len(b)) if word(b[k])), None)
            if at is not None and (run := _grown(b, before, at, at + 1, False, True)):
                yield "insert_before", "".join(b[slice(*run)]), added
        elif p == end:
            if not any(map(word, b[p:])):
                yield "append", None, added
            if run := _grown(b, before, p - 1, p, True, False):
                yield "insert_after", "".join(b[slice(*run)]), added
        elif not added:
            phrase = "".join(b[p:end]).strip(SEPARATORS)
            if not phrase or before.find(phrase) != before.rfind(phrase):
                return  # what goes must be named by itself
            yield "delete", phrase, None
        if run := _grown(b, before, p, end, True, True):
            i, j = run
            yield "replace", "".join(b[i:j]), "".join(b[i:p]) + added + "".join(b[end:j])

    none = ("unsupported", None, None)
    return none if before == after else next((x for x in tries() if edited(before, *x) == after), none)


def edit_kinds(rows: DataFrame) -> DataFrame:
    """rows (id, before, after): kind, phrase and text of each edit; null counts as an empty text."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = [edit_kind(x or "", y or "") for x, y in zip(part["before"].to_pylist(), part["after"].to_pylist())]
            yield pa.RecordBatch.from_arrays([part["id"], *[pa.array([r[k] for r in out], pa.string()) for k in range(len(EDIT))]], names=["id", *EDIT])

    schema = T.StructType([rows.schema["id"], *[T.StructField(c, T.StringType()) for c in EDIT]])
    return rows.select("id", "before", "after").mapInArrow(told, schema)


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of base whose key new doesn't have; null keys are equal to each other."""
    return base.join(_keys(new, keys), _same(base, keys), "left_anti").unionByName(new)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base, and those of new whose key base doesn't have."""
    return base.unionByName(new.join(_keys(base, keys), _same(new, keys), "left_anti"))


def _keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"__other_{k}") for k in keys]).distinct()


def _same(rows: DataFrame, keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(F.col(f"__other_{k}"))
    return cond


@query()
def text_edit_kinds(t: Tables) -> DataFrame:
    """Whole documents against themselves with a word put in front, behind, taken away or changed."""
    d, text = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    after = F.when(d == 0, F.concat(F.lit("New "), text)).when(d == 1, F.concat(text, F.lit(" more"))).when(d == 2, F.regexp_replace(text, r"^(\S+ )(\S+ )", "$1")).when(d == 3, F.regexp_replace(text, r"^(\S+ )(\S+)", "$1other"))
    return edit_kinds(t.documents.select(F.col("doc_id").alias("id"), text.alias("before"), F.coalesce(after, text).alias("after")))


@query("SELECT p_partkey AS id, CASE WHEN p_size >= 25 THEN p_name ELSE p_type END AS body FROM part")
def seeded_queue(t: Tables) -> DataFrame:
    """Parts of size 25 and more are there; of those below 30 only the missing ones are added."""
    row = lambda c, text: t.part.where(c).select(F.col("p_partkey").alias("id"), F.col(text).alias("body"))
    return insert_ignore(row("p_size >= 25", "p_name"), row("p_size < 30", "p_type"), ["id"])


@query("SELECT p_partkey AS id, CASE WHEN p_size < 30 THEN p_type ELSE p_name END AS body FROM part")
def upserted_chunks(t: Tables) -> DataFrame:
    """Parts of size 25 and more are there; those below 30 come with a new text."""
    row = lambda c, text: t.part.where(c).select(F.col("p_partkey").alias("id"), F.col(text).alias("body"))
    return upsert(row("p_size >= 25", "p_name"), row("p_size < 30", "p_type"), ["id"])
