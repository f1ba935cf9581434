"""The tokenizer and shingles against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import text as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text("ab \n\té ", max_size=30)), max_size=8)


@settings(deadline=None, max_examples=200)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = T.buffers(pa.array(texts, pa.string()))
    found = T.words(data, offsets)
    for i, text in enumerate(texts):
        lo, hi = found.bounds[i], found.bounds[i + 1]
        got = [bytes(data[s:e]) for s, e in zip(found.start[lo:hi], found.end[lo:hi])]
        assert got == WORD.findall((text or "").encode())


def test_equal_words_have_equal_hashes_and_others_do_not(monkeypatch):
    texts = pa.array([f"w{i} w{i // 2} Ab" for i in range(500)] + ["aB"])
    whole = T.words(*T.buffers(texts), lower=True)
    monkeypatch.setattr(T, "PIECE", 64)
    pieces = T.words(*T.buffers(texts), lower=True)
    assert (whole.hash == pieces.hash).all()
    assert len(set(whole.hash.tolist())) == 501


def test_a_word_longer_than_a_piece_stays_whole(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 8)
    found = T.words(*T.buffers(pa.array(["x" * 50 + " y", "z" * 20])))
    assert (found.end - found.start).tolist() == [50, 1, 20]


def test_trimming_leaves_out_words_without_letters():
    marks = np.zeros(256, bool)
    marks[list(b".,!")] = True
    data, offsets = T.buffers(pa.array(["a, !! .b.", "..."]))
    found = T.words(data, offsets, trim=marks)
    assert found.bounds.tolist() == [0, 2, 2]
    assert [bytes(data[s:e]) for s, e in zip(found.start, found.end)] == [b"a", b"b"]


def test_short_texts_have_one_shingle():
    sets = T.shingles(T.words(*T.buffers(pa.array(["a b c d e f", "a b", "", "a b"]))), 5)
    assert [len(s) for s in sets] == [2, 1, 0, 1]
    assert sets[1] == sets[3]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 1, 0, 30)])], ["t"])
    parts = list(T.slices([batch], "t", 40))
    assert [p.num_rows for p in parts] == [1, 1, 3]
