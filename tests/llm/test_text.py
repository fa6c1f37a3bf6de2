"""Vectorised words and hashes against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strataflow.llm import _text
from strataflow.llm.ngram_quality import _Lookup
from strataflow.llm.substring_dedup import _distinct, _pack_ids, _unpack_ids

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab A9-\n\t\x0b\x00é漢\U0001f600.", max_size=30)), max_size=8)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for pattern, separators, fold in ((r"[^\x20\x09-\x0D]+", _text.WHITESPACE, False), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _text.NOT_WORDLIKE, True)):
        words = _text.Words(pa.array(texts, pa.string()), separators, fold)
        expected = [re.findall(pattern, lower(t or "") if fold else t or "") for t in texts]
        got = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
        assert got == [w for own in expected for w in own]
        assert words.counts().tolist() == [len(own) for own in expected]
        hashes = words.hashes().tolist()
        assert len(set(zip(hashes, got, strict=True))) == len(set(hashes)) == len(set(got))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 6))
def test_rolling_hashes_tell_windows_apart(values, width):
    found = _text.rolling(np.array(values, dtype=np.uint64), width).tolist()
    windows = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(found) == len(windows)
    assert len(set(zip(found, windows, strict=True))) == len(set(found)) == len(set(windows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=8), st.integers(1, 4))
def test_window_heads_stay_in_a_row(sizes, width):
    first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    expected = [int(first[r]) + p for r, n in enumerate(sizes) for p in range(n - width + 1)]
    assert _text.window_heads(first, width).tolist() == expected
    total = int(first[-1])
    marks = np.zeros(total, dtype=bool)
    for h in expected:
        marks[h : h + width] = True
    assert _text.covered(np.array(expected, dtype=np.int64), width, total).tolist() == marks.tolist()
    a, b = _text.runs(marks)
    assert sum((b - a).tolist()) == int(marks.sum())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=30))
def test_ids_round_trip(ids):
    ids = np.sort(np.array(ids, dtype=np.int64))
    assert _unpack_ids(_pack_ids(ids)).tolist() == ids.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30))
def test_distinct_keeps_first_occurrences(values):
    # pairs that agree in one hash only are different
    pairs = [(v // 2, v % 3) for v in values]
    kept, rank = _distinct(np.array([a for a, _ in pairs], dtype=np.uint64), np.array([b for _, b in pairs], dtype=np.uint32))
    assert [pairs[k] for k in kept] == list(dict.fromkeys(pairs))
    assert [pairs[kept[r]] for r in rank] == pairs


def test_words_that_collide_modulo_a_power_of_two_differ():
    import pyarrow as pa

    a = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    b = "".join("ba"[k.bit_count() % 2] for k in range(2048))
    words = _text.Words(pa.array([a, b, a]))
    hashes, residues = words.hashes(), words.residues()
    assert hashes[0] == hashes[2] != hashes[1] and residues[0] == residues[2] != residues[1]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=200))
def test_lookup_finds_every_key(keys):
    keys = np.array(sorted(keys), dtype=np.uint64)
    values = np.arange(len(keys), dtype=np.float32)
    assert _Lookup(keys, values).get(np.repeat(keys, 2)).tolist() == np.repeat(values, 2).tolist()
