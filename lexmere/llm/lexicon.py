"""Byte-level BPE by a lexicon of frequent pieces, compiled into a minimal acyclic transducer, and exact merges for the rest.

All texts are cut into pieces at places that no unit of the vocabulary spans (``encoding``), and pieces are counted over
the whole table. The most frequent ones become the words of an acyclic automaton whose states with equal futures are one,
so that words share prefixes and suffixes. Its edges put out numbers; their sum along a word's path is the word's place in
the file's list of ids. The file goes into the shared folder, Spark hands a copy to each machine, and all Python workers
there map it into memory. Distinct pieces of a slice of texts walk the automaton together, a byte of all of them at a
time; a piece that it doesn't hold is cut into units and merged by the vocabulary's ranks.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm.common import shared_dir, stage, table
from lexmere.llm.encoding import piece_starts, slices

#: Words of the automaton; the bound of what the driver is told of the corpus.
WORDS = 1 << 19
#: Bytes of the longest word, and pieces outside it that a worker remembers before it starts afresh.
LONGEST, MEMORY = 48, 100_000
#: Fixed value: how a byte-level vocabulary cuts text into units.
UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
HEADER = 4
#: Units of more bytes are merged over a heap; what stands for a pair that is never joined.
SHORT, NEVER = 64, (1 << 60, -1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free
    one after Latin-1."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file of the tokenizers library, without normalizer and prefix space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        cut, model = settings["pre_tokenizer"] or {}, settings["model"]
        plain = settings["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        if not plain or settings["post_processor"] or model["type"] != "BPE" or model["ignore_merges"] or model["dropout"] or model["continuing_subword_prefix"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters, ids = byte_letters(), model["vocab"]
        special = {x["content"]: x["id"] for x in settings["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in settings["added_tokens"]):
            raise ValueError("added tokens that take more than their own letters")
        self.special = {k.encode(): v for k, v in special.items()}
        self.stop = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()

    def merged(self, unit: bytes) -> list[int]:
        """The ids of one unit: the pair of the lowest rank is joined, the leftmost of equal ones, until none is left."""
        ids, pairs = [self.byte_id[b] for b in unit], self.pairs
        if len(ids) > SHORT:
            return self._merged_long(ids)
        found = [pairs.get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) is not NEVER:
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = pairs.get((ids[k - 1], ids[k]), NEVER)
            if k < len(found):
                found[k] = pairs.get((ids[k], ids[k + 1]), NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same over a heap of pairs, in n log n steps."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(found[0], k, pair, found[1]) for k, pair in enumerate(zip(ids, ids[1:])) if (found := pairs.get(pair))]
        heapq.heapify(todo)
        while todo:
            _, k, pair, new = heapq.heappop(todo)
            m = after[k]
            if m >= n or (ids[k], ids[m]) != pair:
                continue  # one of the two has been joined since
            ids[k], ids[m] = new, -1
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] < n and (found := pairs.get(both := (ids[at], ids[after[at]]))):
                    heapq.heappush(todo, (found[0], at, both, found[1]))
        return [i for i in ids if i >= 0]

    def encoded(self, text: str) -> list[int]:
        """The ids of a text, special tokens in it included."""
        out: list[int] = []
        for k, part in enumerate(self.stop.split(text) if self.stop else [text]):
            if k % 2:
                out.append(self.special[part.encode()])
            else:
                for unit in UNIT.findall(part):
                    out += self.merged(unit.encode())
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"))


def compiled(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of words and their ids, as a file: a header of counts, edges sorted by state and byte (key, target,
    number put out), which states end a word, and the words' ids in the order of the words."""
    words = sorted(w for w in entries if w)
    states: dict[tuple, int] = {}
    held: list[list] = [[False, []]]  # the states along the last word, not yet closed: (ends a word, edges)
    last = b""

    def close(depth: int) -> None:
        while len(held) > depth + 1:
            final, edges = held.pop()
            held[-1][1].append((last[len(held) - 1], states.setdefault((final, tuple(edges)), len(states))))

    for w in words:
        shared = next((k for k, (x, y) in enumerate(zip(last, w)) if x != y), min(len(last), len(w)))
        close(shared)
        held += [[False, []] for _ in w[shared:]]
        held[-1][0] = True
        last = w
    close(0)
    states.setdefault((held[0][0], tuple(held[0][1])), len(states))  # the root: the last state
    below, keys, targets, skipped = [], [], [], []
    for s, (final, edges) in enumerate(states):  # a state comes after those that it leads to
        n = int(final)
        for b, target in edges:
            keys.append(s << 8 | b)
            targets.append(target)
            skipped.append(n)
            n += below[target]
        below.append(n)
    ids = [entries[w] for w in words]
    starts = np.cumsum([0, *map(len, ids)])
    parts = [
        np.array([len(keys), len(states), len(words), starts[-1]], "<i8"),
        np.array(keys, "<i8"),
        starts.astype("<i8"),
        np.array(targets, "<i4"),
        np.array(skipped, "<i4"),
        np.array([i for x in ids for i in x], "<i4"),
        np.array([final for final, _ in states], "<i1"),
    ]
    return b"".join(p.tobytes() for p in parts)


class Transducer:
    """A compiled file, mapped into memory."""

    def __init__(self, raw: np.ndarray):
        self.n_edges, self.n_states, self.n_words, n_ids = (int(x) for x in raw[: 8 * HEADER].view("<i8"))
        at = 8 * HEADER

        def part(n: int, kind: str) -> np.ndarray:
            nonlocal at
            begin, at = at, at + n * np.dtype(kind).itemsize
            return raw[begin:at].view(kind)

        self.keys, self.starts = part(self.n_edges, "<i8"), part(self.n_words + 1, "<i8")
        self.targets, self.skipped, self.ids, self.final = part(self.n_edges, "<i4"), part(self.n_edges, "<i4"), part(n_ids, "<i4"), part(self.n_states, "<i1")

    def numbers(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each string (where it starts in data and its length in bytes), or -1."""
        state = np.full(len(start), self.n_states - 1, np.int64)
        out = np.zeros(len(start), np.int64)
        on, k = np.flatnonzero(length > 0), 0
        while len(on) and self.n_edges:
            key = state[on] << 8 | data[start[on] + k]
            at = np.minimum(np.searchsorted(self.keys, key), self.n_edges - 1)
            hit = self.keys[at] == key
            state[on[~hit]] = -1
            on, at = on[hit], at[hit]
            state[on] = self.targets[at]
            out[on] += self.skipped[at]
            k += 1
            on = on[length[on] > k]
        known = (state >= 0) & (length > 0)
        known[known] = self.final[state[known]] == 1
        return np.where(known, out, -1)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of texts, all pieces as places among them, and of each text the number of pieces up to its end."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    first, last = int(bounds[0]), int(bounds[-1])
    at = np.zeros(last - first + 1, bool)
    if last > first:
        at[:-1] = piece_starts(np.frombuffer(data, np.uint8)[first:last])
    at[bounds - first] = True
    at = np.flatnonzero(at).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data.slice(first) if data is not None else pa.py_buffer(b"")).dictionary_encode()
    return pieces.dictionary, pieces.indices.to_numpy(), np.searchsorted(at, bounds[1:] - first)


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where strings lie: data, start and length of each."""
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds[:-1], np.diff(bounds)


class Coder:
    """Ids of texts, by a transducer and a vocabulary."""

    def __init__(self, words: Transducer, vocab: Vocabulary):
        self.words, self.vocab = words, vocab
        self.met: dict[str, list[int]] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        pieces, which, ends = cut(texts)
        number = self.words.numbers(*bytes_of(pieces))
        start, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        known, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        start[known] = self.words.starts[number[known]]
        size[known] = self.words.starts[number[known] + 1] - start[known]
        others = [self._merged(x) for x in pieces.take(pa.array(new)).to_pylist()]
        size[new] = [len(x) for x in others]
        start[new] = len(self.words.ids) + np.cumsum(size[new]) - size[new]
        flat = np.concatenate((self.words.ids, np.fromiter((i for x in others for i in x), np.int32, int(size[new].sum()))))
        n = size[which]
        done = np.concatenate(([0], np.cumsum(n)))
        return flat[np.repeat(start[which] - done[:-1], n) + np.arange(done[-1])], np.diff(done[ends], prepend=0)

    def _merged(self, piece: str) -> list[int]:
        if (ids := self.met.get(piece)) is None:
            ids = self.vocab.encoded(piece)
            if len(piece) <= LONGEST:
                if len(self.met) >= MEMORY:
                    self.met.clear()
                self.met[piece] = ids
        return ids


def frequent_pieces(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> DataFrame:
    """(piece) of the most frequent pieces of at most LONGEST bytes over all texts: at most so many, each found twice or
    more. Pieces are taken by classes of frequency (eight for each doubling), the last class that doesn't fit whole not at all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.string()).fill_null("")
            for at, n in slices(texts):
                pieces, which, _ = cut(texts.slice(at, n))
                sums = np.bincount(which, minlength=len(pieces))
                short = np.flatnonzero(bytes_of(pieces)[2] <= LONGEST)
                yield pa.RecordBatch.from_arrays([pieces.take(pa.array(short)), pa.array(sums[short].astype(np.int64))], names=["piece", "n"])

    counts = docs.select(text_col).mapInArrow(count, "piece string, n long").where("piece <> ''").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = stage(counts.where("n > 1").select("piece", F.floor(F.log2("n") * 8).alias("class")), "pieces")
    least, left = None, most
    for c, n in sorted(map(tuple, counts.groupBy("class").count().collect()), reverse=True):  # 512 classes at most
        if n > left:
            break
        least, left = c, left - n
    return counts.where(F.col("class") >= least if least is not None else F.lit(False)).select("piece")


def write_lexicon(spark: SparkSession, docs: DataFrame, text_col: str = "text", vocab_path: str | None = None, most: int = WORDS) -> str:
    """Compiles the most frequent pieces of all texts, writes the file to the shared folder and has Spark hand it to every
    machine. Returns the name by which tasks find it. The file takes some 20 MB at most, however many texts there are."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vocab.encoded(x) for x in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["piece", "ids"])

    words = frequent_pieces(docs, text_col, most).mapInArrow(ids_of, "piece string, ids array<int>").toArrow()  # at most ``most``
    raw = compiled({w.encode(): ids for w, ids in zip(words.column(0).to_pylist(), words.column(1).to_pylist(), strict=True)})
    folder = shared_dir(spark, "lexicon")
    name = f"{folder.rsplit('/', 1)[1]}.bin"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(raw))
    out.close()
    context.addFile(path.toString())
    return name


@functools.lru_cache(maxsize=1)
def coder(name: str, vocab_path: str | None = None) -> Coder:
    """A worker's coder: the file as this machine has it, mapped; machines that join later fetch it themselves."""
    return Coder(Transducer(np.memmap(SparkFiles.get(name), np.uint8, "r")), vocabulary(vocab_path))


def encode(docs: DataFrame, lexicon: str, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs, as the vocabulary's own library gives them without added tokens.

    A null or empty text has no ids. Texts are encoded whole, however long; special tokens that a text spells out become
    their id. Repeated rows, null identifiers and other columns, whatever their names, do no harm; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(lexicon, vocab_path)
        for b in batches:
            texts = b.column(1).cast(pa.string()).fill_null("")
            for at, n in slices(texts):
                ids, sizes = mine.encode(texts.slice(at, n))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(rows: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """rows (doc_id, ids) with text: what the ids spell, special tokens included; null ids are none. Ids that the
    vocabulary doesn't have raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for b in batches:
            texts = [vocab.decoded(x.values.to_numpy().tolist() if x.is_valid else []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, text string")


def op12_bpe_lexicon(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, write_lexicon(spark, docs)))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
