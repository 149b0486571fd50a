from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmere.llm import lexicon

from .conftest import ROWS

WORDS = ["the", "this", "these", "those", "tops", "stops", "stop", "at", "hats", " hats", "Fuchs", "Füchse", "x" * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def mapped(words):
    vocab = lexicon.vocabulary()
    return lexicon.Transducer(np.frombuffer(lexicon.compiled({w.encode(): vocab.encoded(w) for w in words}), np.uint8))


def test_transducer_holds_its_words_alone():
    t = mapped(WORDS)
    asked = pa.array([*WORDS, "th", "thes", "stopss", "zebra", "", "hat", "Füchs", "xx"])
    numbers = t.numbers(*lexicon.bytes_of(asked)).tolist()
    by_bytes = sorted(WORDS, key=str.encode)
    assert numbers == [by_bytes.index(w) for w in WORDS] + [-1] * 8
    vocab = lexicon.vocabulary()
    assert all(t.ids[t.starts[k] : t.starts[k + 1]].tolist() == vocab.encoded(w) for k, w in enumerate(by_bytes))


def futures(words):
    """Sets of word ends that follow some prefix: a minimal automaton has a state for each."""
    return {frozenset(w[k:] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in [len(p)]}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=25))
def test_automaton_is_minimal(words):
    t = lexicon.Transducer(np.frombuffer(lexicon.compiled({w.encode(): [len(w)] for w in words}), np.uint8))
    assert t.n_states == len(futures(words)) and t.n_words == len(words)
    assert t.numbers(*lexicon.bytes_of(pa.array(sorted(words)))).tolist() == list(range(len(words)))


def test_empty_transducer():
    t = lexicon.Transducer(np.frombuffer(lexicon.compiled({}), np.uint8))
    assert t.numbers(*lexicon.bytes_of(pa.array(["a", ""]))).tolist() == [-1, -1]


PARTS = st.one_of(
    st.text(max_size=8),
    st.sampled_from([" the", "the", "  ", "\n\n", "\r\n", "<|endoftext|>", "<|endof", "'s", "'LL", "don't", " 1234", "é", " ", "　", "…", "\x1c", "\x85", "𝔘", "😀", " hats", "Füchse", "\t", "a" * 60]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=5))
def test_ids_are_the_librarys(library, texts):
    coder = lexicon.Coder(mapped(WORDS), lexicon.vocabulary())
    ids, sizes = coder.encode(pa.array(texts, pa.string()))
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [coder.vocab.decoded(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids_are_decoded_as_the_library_does(library, ids):
    assert lexicon.vocabulary().decoded(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_units(library):
    vocab = lexicon.vocabulary()
    for unit in [b" antidisestablishmentarianism", "Füchse".encode(), b"aaaaaaaaaaaa", bytes(range(64))]:
        assert vocab.merged(unit) == vocab._merged_long([vocab.byte_id[b] for b in unit])
    text = "ab" * 20_000 + " " + "é!" * 5000 + " " * 3000
    assert lexicon.vocabulary().encoded(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [lexicon.WORDS, 3, 0])
def test_documents(spark, odd, library, most):
    name = lexicon.write_lexicon(spark, odd, most=most)
    got = lexicon.decode(lexicon.encode(odd, name)).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark, no_rows):
    assert lexicon.decode(lexicon.encode(no_rows, lexicon.write_lexicon(spark, no_rows))).count() == 0


def test_pieces_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(k, "one two two") for k in range(5)] + [(9, None)], "doc_id long, text string").repartition(3)
    assert [r.piece for r in lexicon.frequent_pieces(docs, most=1).collect()] == [" two"]
    assert sorted(r.piece for r in lexicon.frequent_pieces(docs).collect()) == [" two", "one"]


def test_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        text = library.decode(e.ids, skip_special_tokens=False)
        want[r.doc_id] = (len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in lexicon.op12_bpe_lexicon(spark, sf_dir).collect()} == want
