"""Token ids of whole texts with the tokenizers library.

Both vocabularies used here cut a text into units before they merge bytes. No unit spans a single space before a
non-space, the end of a run of Latin letters before a common punctuation mark, or a lone line break before a letter.
The ids of a text are therefore the ids of its pieces between such places, one after the other. All places of a slice
of texts are found at once over its bytes, Arrow finds the distinct pieces, only these are looked up among the pieces
that a Python worker has met, and the ids of all are gathered at once. Vocabularies that cut texts in another way
encode whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces that a worker remembers; beyond, it starts afresh.
MEMORY = 250_000
#: Longer pieces are encoded each time that they occur in a slice.
LONGEST = 48
#: Bytes of text (about) that are encoded together.
SLICE = 3 << 20
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: How a space looks to a byte-level model; ASCII letters look like themselves.
SPACE = "Ġ"


def bytes_of(values: bytes | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: ASCII letters; marks that may end a word; bytes that only characters other than spaces start with (ASCII ones, and
#: lead bytes but for those that some Unicode space has).
LETTER = bytes_of([*range(65, 91), *range(97, 123)])
MARK = bytes_of(b".,;:!?|*#$%&\n")
ASCII = bytes_of([*range(0x21, 0x7F)])
BEGIN = ASCII | bytes_of([0xC3, *range(0xC4, 0xE1), *range(0xE4, 0xF5)])


def piece_starts(raw: np.ndarray) -> np.ndarray:
    """Whether a piece may start at each byte of UTF-8 texts that lie one after the other."""
    n = len(raw)
    at = np.zeros(n, bool)
    if n < 3:
        return at
    letter = LETTER[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    letter[second[(raw[second] != 0x97) & (raw[second] != 0xB7)]] = True  # these two are signs
    space = raw == 0x20
    at[1:-1] = space[1:-1] & ~space[:-2] & BEGIN[raw[2:]]
    at[1:] |= letter[:-1] & MARK[raw[1:]]
    line = np.flatnonzero(raw[1:-1] == 0x0A) + 2
    at[line] |= (letter | ASCII[raw])[line - 2] & LETTER[raw[line]]
    for k in np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)):  # "<|": special tokens stay whole
        at[k + 1 : k + 16] = False
    return at


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about ``most`` bytes, of one text at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(total):
        end = max(start + 1, int(np.searchsorted(total, done + most, side="right")))
        yield start, end - start
        start, done = end, int(total[end - 1])


class Encoder:
    """Ids of texts as unsigned 16-bit integers.

    spaced: the vocabulary sees the space before a word as part of it (byte_bpe_50k) rather than dropping it.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary doesn't fit 16 bits")
        self.cuttable = _cuttable(json.loads(self.tokenizer.to_str()), spaced)
        self._forget()

    def _forget(self) -> None:
        """Entry 0 is the end of a text."""
        self.index: dict[str, int] = {}
        self.entries, self.used = 1, 1
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.size[0] = 1
        self.flat = np.zeros(1 << 16, np.uint16)

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has; end_id, if given, ends each text.

        Null counts as empty.
        """
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("").cast(pa.string())
        if not self.cuttable:
            each = [np.append(np.frombuffer(x, np.uint16), [end_id] * (end_id is not None)) for x in self._each(texts.to_pylist())]
            return np.concatenate([np.zeros(0, np.uint16), *each]).astype(np.uint16), np.array([len(x) for x in each], np.int64)
        if len(self.index) > MEMORY:
            self._forget()
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        first, last = int(bounds[0]), int(bounds[-1])
        at = np.zeros(last - first + 1, bool)
        if last > first:
            at[:-1] = piece_starts(np.frombuffer(data, np.uint8)[first:last])
        at[bounds - first] = True
        at = np.flatnonzero(at).astype(np.int32)  # each text's start and, where it isn't empty, its pieces'
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data.slice(first) if data is not None else pa.py_buffer(b"")).dictionary_encode()
        place, long = self._places(pieces.dictionary.to_pylist())
        piece = place[pieces.indices.to_numpy()]
        ends = np.searchsorted(at, bounds[1:] - first)  # of each text, the piece after its last one
        if end_id is not None:
            self.flat[0] = end_id
            piece = np.insert(piece, ends, 0)
            ends = ends + np.arange(1, len(ends) + 1)
        n = self.size[piece]
        done = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.start[piece] - done[:-1], n) + np.arange(done[-1])]
        for x in long:
            del self.index[x]
        return ids, np.diff(done[ends], prepend=0)

    def _places(self, pieces: list[str]) -> tuple[np.ndarray, list[str]]:
        """The entry of each piece, and which are long ones, to be forgotten once used."""
        index = self.index
        new = [x for x in pieces if x not in index]
        long = [x for x in new if len(x) > LONGEST]
        self._keep(self._learn([x for x in new if len(x) <= LONGEST]))
        short = self.entries, self.used
        self._keep(dict(zip(long, self._each(long), strict=True)))
        self.entries, self.used = short  # the long ones' places are taken again after this slice
        return np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces)), long

    def _keep(self, ids: dict[str, bytes]) -> None:
        """Adds entries."""
        if not ids:
            return
        raw = np.frombuffer(b"".join(ids.values()), np.uint16)
        n = np.fromiter(map(len, ids.values()), np.int64, len(ids)) // 2
        while self.used + len(raw) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.entries + len(n) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        at = slice(self.entries, self.entries + len(n))
        self.flat[self.used : self.used + len(raw)] = raw
        self.start[at], self.size[at] = self.used + np.cumsum(n) - n, n
        self.index.update(zip(ids, range(at.start, at.stop), strict=True))
        self.entries, self.used = at.stop, self.used + len(raw)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        got: dict[str, bytes] = {}
        words, others = [], []
        merge, spaced = self.tokenizer.model.tokenize, self.spaced
        for x in pieces:
            if not WORD.fullmatch(x):
                others.append(x)
            elif x.isascii():  # a single unit that only the model's merges are left to apply to
                unit = x.replace(" ", SPACE) if spaced else x.strip(" ").lower()
                got[x] = array("H", [t.id for t in merge(unit)]).tobytes()
            else:
                words.append(x)
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            got.update(zip(part, self._words(part), strict=True))
        got.update(zip(others, self._each(others), strict=True))
        return got

    def _each(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 5000):
            out += [np.array(e.ids, np.uint16).tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + 5000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of single words, encoded together with line breaks between them."""
        e = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ids, at = np.array(e.ids, np.uint16), np.array(e.word_ids, np.int64)
        each = 2 if self.spaced else 1  # there the line breaks are units of their own
        starts = np.searchsorted(at, np.arange(0, each * len(words), each))
        ends = np.searchsorted(at, np.arange(0, each * len(words), each), side="right")
        if at.max(initial=-1) != each * (len(words) - 1) or (starts == ends).any():
            return self._each(words)
        raw = ids.tobytes()
        return [raw[2 * i : 2 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def _cuttable(settings: dict, spaced: bool) -> bool:
    """Whether the vocabulary cuts texts as the pieces here take for granted."""
    cut = settings["pre_tokenizer"] or {}
    if spaced:
        return settings["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
    steps = [x["type"] for x in (settings["normalizer"] or {}).get("normalizers", [])]
    units = [x.get("pattern", {}).get("Regex") for x in cut.get("pretokenizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and units == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", None]


@functools.cache
def word_encoder(path: str | None = None) -> Encoder:
    return Encoder(path or public_tokenizers.path("word_bpe_49k.json"), spaced=False)


@functools.cache
def byte_encoder(path: str | None = None) -> Encoder:
    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"), spaced=True)
