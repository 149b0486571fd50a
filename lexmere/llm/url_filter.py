"""URL filters by a bit-parallel wildcard automaton.

Glob rules become one row of bits, packed into 64-bit words. A batch of canonical URLs is read byte position by byte
position; for each URL the words hold the states of all rules at once (extended Shift-And): a state moves on where its
byte mask allows, and wildcard states keep themselves alive on the bytes of their class.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.llm.common import UPPER

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


class Automaton:
    """All rules as masks. Canonical form of a URL: a dot, the host, the path.

    A rule (host, path) is the glob ``<host-star>.host`` + path + ``*``, where host-star stands for any bytes but a
    slash; in a rule's host and path ``*`` stands for any bytes (in a host, any but a slash) and ``?`` for one. A rule
    has matched once its last state was alive at some position.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        masks: list[np.ndarray] = []  # of each state: bytes that lead into it
        loops: list[np.ndarray] = []  # of each state: bytes on which it stays alive
        starts: list[int] = []
        self.ends: list[int] = []
        every, slash = np.ones(256, bool), np.ones(256, bool)
        slash[ord("/")] = False
        none = np.zeros(256, bool)
        for host, path, _ in rules:
            starts.append(len(masks))
            masks.append(none)
            loops.append(slash)
            in_host = True
            for byte in f".{host}{path}".encode():
                in_host = in_host and byte != ord("/")
                if byte == ord("*"):
                    loops[-1] = loops[-1] | (slash if in_host else every)
                    continue
                one = none.copy()
                one[byte] = True
                masks.append((slash if in_host else every) if byte == ord("?") else one)
                loops.append(none)
            self.ends.append(len(masks) - 1)
        self.words = max(1, -(-len(masks) // 64))
        self.move, self.stay = self._pack(masks), self._pack(loops)
        self.init = np.zeros(self.words, np.uint64)
        for s in starts:
            self.init[s // 64] |= np.uint64(1 << (s % 64))

    def _pack(self, states: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for s, by in enumerate(states):
            out[by, s // 64] |= np.uint64(1 << (s % 64))
        return out

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """A row of booleans, one for each rule, for each URL."""
        n = len(urls)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)
        at = (ends - lengths)[order]
        flat = np.frombuffer(b"".join(urls), np.uint8)
        live = np.repeat(self.init[None, :], n, axis=0)
        seen = np.zeros_like(live)
        falling = -lengths[order]
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(falling, -j, side="left"))  # only URLs longer than j
            state, byte = live[:m], flat[at[:m] + j]
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.move[byte]) | (state & self.stay[byte])
            live[:m] = state
            seen[:m] |= state
        hit = np.empty((n, len(self.ends)), bool)
        for k, e in enumerate(self.ends):
            hit[order, k] = (seen[:, e // 64] >> np.uint64(e % 64)) & one != 0
        return hit


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, then the
    path up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict.

    Of the rules that match, the longest (host and path together; of equal ones the first) decides; where none does,
    rule is null and the verdict is ``default``. Null URLs and URLs without ``://`` have an empty host and path and so
    match no rule. Repeated rows give repeated rows; an empty table an empty result. Other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    names = [f"{h}{p}" for h, p, _ in ranked] + [None]
    verdicts = [v for _, _, v in ranked] + [default]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(ranked)
        for b in batches:
            urls = [f".{h}{p}".encode() for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            hit = automaton.matches(urls)
            best = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked)) if len(ranked) else np.zeros(len(urls), int)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([names[k] for k in best], pa.string()), pa.array([verdicts[k] for k in best], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def op4_url_filter(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


OP4_SQL = """
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '\\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '\\A[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""
