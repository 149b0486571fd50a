"""Best-two-fit packing of documents into sequences of at most 1024 tokens.

Documents are encoded where they are read and only the lengths of their pieces move: pieces are dealt evenly to groups
of about ``GROUP`` pieces, each packed in a task of its own, so that only the last sequence of each group is left
partly empty. In a group, every sequence is filled greedily with the longest pieces that fit; while a gap is left, its
smallest piece is exchanged for the two unpacked pieces that together fill the widened gap most tightly.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.llm.common import stage
from lexmere.llm.encoding import Encoder, byte_encoder, slices

CAPACITY = 1024
END_ID = 2
#: Pieces that are packed together (up to twice as many in the last group of a task), and tasks at most.
GROUP, TASKS = 4096, 4000
PIECES = "piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if they fit, else full pieces after a first one of the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, capacity: int = CAPACITY, encoder: Callable[[], Encoder] = byte_encoder, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document (doc_id, text): doc_id, piece, start, length, ids_crc32. A null text is empty."""
    rows = docs.select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for b in batches:
            for at, n in slices(b.column(1)):
                ids, sizes = enc.encode(b.column(1).slice(at, n), end_id)
                wide = memoryview(ids.astype("<u4").tobytes())
                source, out, first = [], [], 0
                for k, size in enumerate(sizes.tolist(), at):
                    for p, (start, length) in enumerate(cut_points(size, capacity)):
                        source.append(k)
                        out.append((p, start, length, zlib.crc32(wide[4 * (first + start) : 4 * (first + start + length)])))
                    first += size
                cols = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(source, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, c]) for c in (1, 2, 3))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(cut, f"doc_id {dict(rows.dtypes)['doc_id']}, {PIECES}")


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; lengths from 1 to capacity. Equal lengths are taken in order of position."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(capacity + 2))
    nxt = ends[:-1].copy()  # of each length, the next unpacked item in order
    left = ends[1:] - nxt
    back: dict[int, list[int]] = {}  # items that an exchange has put back
    values = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(left > 0, values, 0))  # the longest unpacked length up to each

    def take(n: int) -> int:
        left[n] -= 1
        if not left[n]:
            m = int(below[n - 1])
            upto = np.searchsorted(below, n, side="right")
            below[n:upto] = m
        if back.get(n):
            return back[n].pop()
        nxt[n] += 1
        return int(order[nxt[n] - 1])

    def put(n: int, item: int) -> None:
        back.setdefault(n, []).append(item)
        left[n] += 1
        if left[n] == 1:
            upto = np.searchsorted(below, n, side="left")
            below[n:upto] = n

    of, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins = 0
    while below[capacity]:
        held: list[tuple[int, int]] = []
        gap = capacity
        while True:
            while gap and below[gap]:
                n = int(below[gap])
                held.append((n, take(n)))
                gap -= n
            if not gap or len(held) < 2 or not below[capacity]:
                break
            k = min(range(len(held)), key=lambda i: held[i][0])
            small, item = held[k]
            room = small + gap
            a = values[1 : room // 2 + 1][left[1 : room // 2 + 1] > 0]  # the shorter of the two
            b = below[room - a]
            fits = (b > a) | ((b == a) & (left[a] > 1))
            total = np.where(fits, a + b, 0)
            if not len(total) or total.max() <= small:
                break
            j = int(total.argmax())
            held.pop(k)
            for n in (int(b[j]), int(a[j])):
                held.append((n, take(n)))
            put(small, item)
            gap = room - int(total[j])
        offset = 0
        for n, i in sorted(held, key=lambda x: -x[0]):
            of[i], at[i] = bins, offset
            offset += n
        bins += 1
    return of, at


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Groups come from an even deal of all rows, whatever their identifiers; a task packs one group after the other. A
    sequence_id is the number of its task times 2**40 plus its number there.
    """
    rows = stage(rows, "pieces")
    tasks = min(TASKS, max(1, round(rows.count() / group)))
    kind = dict(rows.dtypes)["doc_id"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for t in grouped(batches, group):
            t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
            of, at = best_two_fit(t.column("length").to_numpy().astype(np.int64), capacity)
            t = t.append_column("sequence_id", pa.array(of + base)).append_column("offset", pa.array(at))
            yield from t.to_batches()
            base += int(of.max()) + 1

    return rows.repartition(tasks).mapInArrow(fill, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")


def grouped(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of group rows; the last one has up to twice as many."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < 2 * group:
            continue
        t = pa.Table.from_batches(held)
        while n >= 2 * group:
            yield t.slice(0, group)
            t, n = t.slice(group), n - group
        held = t.to_batches()
    if n:
        yield pa.Table.from_batches(held)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row for each piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than capacity are cut; then the first piece may be shorter. A null text is empty and has its
    end id alone. Repeated rows are packed as often as they occur; null identifiers like others; an empty table gives
    an empty result. Other columns are ignored. Every sequence is gapless from 0.
    """
    return pack(pieces(docs, capacity), capacity, group)


def op7_best_two_fit(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
