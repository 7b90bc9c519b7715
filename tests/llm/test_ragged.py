from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import ragged

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab A\t\n\x0bé漢\x85\xa0", max_size=12)), max_size=6)


def spans(column):
    data, offsets = ragged.text_bytes(column)
    starts, ends, firsts = ragged.word_spans(data, offsets)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    return [found[a:b] for a, b in zip(firsts[:-1], firsts[1:])]


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    import re

    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    column = pa.array(texts, pa.string())
    assert spans(column) == [pattern.findall(t or "") for t in texts]
    assert spans(column.slice(1)) == [pattern.findall(t or "") for t in texts[1:]]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data, offsets = ragged.text_bytes(pa.array(["ab Ab abc", "x ab", "AB ba"]))
    hashes, firsts = ragged.word_hashes(data, offsets)
    ab = hashes[0]
    assert [h == ab for h in hashes.tolist()] == [True, True, False, False, True, True, False]
    assert firsts.tolist() == [0, 3, 5, 7]


def turns(n):
    """The word of 2^n letters in which each half is the other one turned round."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_of_a_regular_build_have_hashes_of_their_own():
    one = turns(10)
    other = one.translate(str.maketrans("ab", "ba"))
    rng = np.random.default_rng(2)
    words = {one, other, one + other, other + one, "a" * 512, "a" * 513, "a" * 5000, "a" * 5001, "a" * 300_000}
    words |= {"a" * n + "b" + "a" * (600 - n) for n in range(600)}
    words |= {"".join(rng.choice(list("abc"), n)) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 511) for _ in range(50)}
    words = sorted(words)
    data, offsets = ragged.text_bytes(pa.array([" ".join(words), "x " + " ".join(words)]))
    hashes, firsts = ragged.word_hashes(data, offsets)
    assert len(np.unique(hashes[: firsts[1]])) == len(words)
    assert hashes[: firsts[1]].tolist() == hashes[firsts[1] + 1 :].tolist()
    codes = np.array([ord(c) for c in one + other], dtype=np.uint32)
    half = np.array([0, len(one)])
    assert len(set(ragged.span_hashes(codes, half, half + len(one)).tolist())) == 2


def test_portions_cover_all_rows_and_keep_long_ones_whole():
    offsets = np.array([0, 5, 5, 500, 501, 502])
    assert list(ragged.portions(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(ragged.portions(np.array([0]), 10)) == []


def test_index_finds_what_was_added():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(1024))
    index = ragged.Index(keys[:100])
    index.add(keys[100:4000], np.arange(100, 4000))
    found = index.find(keys)
    assert (found[:4000] == np.arange(4000)).all() and (found[4000:] == -1).all()
    assert (ragged.Index().find(keys[:3]) == -1).all()
    assert ragged.Index(np.zeros(1, np.uint64)).find(np.zeros(2, np.uint64)).tolist() == [0, 0]


def test_ranges():
    assert ragged.ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
