import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from burrow.llm import kernels as K

TEXTS = st.lists(st.text(alphabet=" \n\tabAB éx ", max_size=30), max_size=8)


def as_slices(texts, limit=K.SLICE):
    return list(K.slices(pa.array([t.encode() for t in texts], pa.binary()), limit))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_match_the_expression(texts):
    for first, end, data, offsets in as_slices(texts):
        starts, ends, rows = K.words(data, offsets)
        found = [[] for _ in range(end - first)]
        for s, e, r in zip(starts, ends, rows):
            found[r].append(data[s:e].tobytes().decode())
        assert found == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts[first:end]]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    ((_, _, data, offsets),) = as_slices(["ab cd", "x ab", "cd ab ab"])
    starts, ends, _ = K.words(data, offsets)
    named = {}
    for s, e, h in zip(starts, ends, K.word_hashes(data, starts, ends)):
        named.setdefault(data[s:e].tobytes(), set()).add(int(h))
    assert all(len(v) == 1 for v in named.values()) and len(set.union(*named.values())) == len(named)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(2, 5))
def test_shingles_partition_as_their_word_sequences_do(texts, size):
    names = {}
    for first, end, data, offsets in as_slices(texts):
        starts, ends, rows = K.words(data, offsets)
        hashes, at = K.shingles(K.word_hashes(data, starts, ends), rows, size)
        got = [[] for _ in range(end - first)]
        for h, r in zip(hashes, at):
            got[r].append(int(h))
        for t, g in zip(texts[first:end], got):
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            want = [tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
            assert len(g) == len(want)
            for x, y in zip(want, g):
                assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)


def test_slices_cover_all_rows_and_nulls_are_empty():
    column = pa.array([b"a" * 10, None, b"", b"b" * 25, b"c"], pa.binary())
    got = list(K.slices(column, 12))
    assert [x for f, e, *_ in got for x in range(f, e)] == list(range(5))
    assert b"".join(d.tobytes() for *_, d, _ in got) == b"a" * 10 + b"b" * 25 + b"c"
    assert list(K.slices(column.slice(3, 2), 12))[0][2].tobytes() == b"b" * 25


def test_words_of_nothing():
    assert len(K.words(np.zeros(0, np.uint8), np.array([0, 0]))[0]) == 0


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_hashes_dont_depend_on_pieces(texts, chunk):
    for _, _, data, offsets in as_slices(texts):
        low = K.ascii_lower(data)
        starts, ends, rows = K.words(low, offsets)
        found = list(K.hashed_words(data, offsets, True, chunk))
        assert np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)]).tolist() == K.word_hashes(low, starts, ends).tolist()
        assert np.concatenate([np.zeros(0, np.int64), *(r for _, r in found)]).tolist() == rows.tolist()


def test_hashes_of_heads():
    data = np.frombuffer(b"abcdef abcxyz", np.uint8)
    assert (K.head_hashes(data, np.array([0, 7]), 3) == K.word_hashes(data, np.array([0, 7]), np.array([3, 10]))).all()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. !é", max_size=80), st.integers(4, 20))
def test_pieces_cover_a_text(text, limit):
    data = np.frombuffer(text.encode(), np.uint8)
    stops, solid = np.zeros(256, bool), np.ones(256, bool)
    stops[ord(".")] = True
    solid[[ord(" "), ord("."), ord("!")]] = False
    got = list(K.pieces(data, np.array([0, len(data)]), stops, solid, limit))
    assert b"".join(p.tobytes() for p, *_ in got) == data.tobytes() and all(len(p) <= limit for p, *_ in got if len(data) > limit)
    assert [int(s[0]) for *_, s in got] == list(np.cumsum([0, *(len(p) for p, *_ in got)])[:-1])
