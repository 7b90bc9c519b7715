from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievework.llm.bpe import Encoder
from sievework.llm.packing import PackSettings, RoomTree, first_fit_decreasing, pack
from sievework.llm.token_counts import token_counts
from tests.llm.common import documents, odd_rows, prose, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(encoder, texts):
    return [
        ids[a:b].tolist()
        for _, ids, edges in encoder.encode(texts)
        for a, b in zip(edges[:-1], edges[1:])
    ]


def test_ids_are_those_of_the_library(library):
    rng = random.Random(3)
    parts = [
        "a", "b", "st", "re", "'", "''", "'s", "'ll", "'RE", " ", "  ", "\n", "\t", "\r\n", "7", "23", "!", "...",
        "é", "ß", "漢", "\U0001f642", "\x00", "\x1c", "\x85", "़", "٣", "²", "aaaaaaa", "​",
        "<|endoftext|>", "<|endof", "ǅ", "꟎",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["", "  ", "a" * 3000, "ab" * 2000, " " * 500, "<|endoftext|>", "<|endoftext|><|endoftext|>x"]
    encoder = Encoder(PATH)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(encoder, texts) == expected
    assert encoder.counts(texts).tolist() == [len(ids) for ids in expected]


def test_long_words_of_a_regular_build(library):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(Encoder(PATH), texts) == expected
    assert len(expected[0]) != len(expected[1])


def test_special_strings_as_plain_text(library):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>"]
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    expected = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(Encoder(PATH, specials=False), texts) == expected


def test_the_store_may_start_anew(library, monkeypatch):
    monkeypatch.setattr("sievework.llm.bpe.KEPT", 10)
    monkeypatch.setattr("sievework.llm.bpe.PORTION", 50)
    texts = [prose(i, 20) for i in range(30)] + ["x <|endoftext|> y"]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(Encoder(PATH), texts) == expected


def test_counts_of_odd_rows(spark, library):
    rows = with_clashes(documents(spark))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"])
                 for r in token_counts(rows, PATH).collect())
    expected = []
    for doc_id, text, *_ in odd_rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id is None, doc_id or 0, len((text or "").encode()), n, n > 1024))
    assert got == sorted(expected)
    assert token_counts(documents(spark, []), PATH).collect() == []


def test_first_fit_decreasing_against_a_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets = first_fit_decreasing(sizes, 100)
        room, expected = [], np.zeros((len(sizes), 2), int)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            expected[i] = at, 100 - room[at]
            room[at] -= sizes[i]
        assert bins.tolist() == expected[:, 0].tolist() and offsets.tolist() == expected[:, 1].tolist()
    assert RoomTree(1, 5).place(5) == (0, 5)


def test_pieces_hold_every_id_once(spark, library):
    settings = PackSettings(length=64, group=4)
    pieces = pack(with_clashes(documents(spark)), PATH, settings=settings).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    expected = []
    for doc_id, text, *_ in odd_rows():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 64):
            part = np.array(ids[at : at + 64], "<u4")
            expected.append((str(doc_id), at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    got = [(str(p["doc_id"]), p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces]
    assert sorted(got) == sorted(expected)
    assert pack(documents(spark, []), PATH).collect() == []


def test_little_padding(spark):
    rows = [(i, prose(i, 20 + i % 300), "en", "a", 1) for i in range(400)]
    pieces = pack(documents(spark, rows), PATH).toPandas()
    filled = pieces.groupby("sequence_id")["length"].sum()
    assert filled.sum() / (2048 * len(filled)) > 0.97
