from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievework.llm.alignment import AlignSettings, token_alignment, tokens_of_a
from tests.llm.common import documents, odd_rows, prose, with_clashes

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def plainly(texts, a, b):
    """The figures of each text by loops over tokens and bytes."""
    bytes_a = tokens_of_a(PATH_A)

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("\u2581", " ").encode()

    tokens = []
    for text in texts:
        both = [], []
        if text:
            both = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            made = b"".join(bytes_a[i] for i in both[0]), b"".join(bytes_b(i) for i in both[1])
            if made != ((" " + text).encode(),) * 2:
                both = [], []
        tokens.append(both)
    groups, times = [], Counter()
    for ids_a, ids_b in tokens:
        ends, at = {}, 0
        for i, token in enumerate(ids_a):
            at += len(bytes_a[token])
            ends[at] = i
        own, at, last_a, last_b = [], 0, -1, -1
        for j, token in enumerate(ids_b):
            at += len(bytes_b(token))
            if at in ends:
                own.append((ids_a[last_a + 1 : ends[at] + 1], ids_b[last_b + 1 : j + 1]))
                last_a, last_b = ends[at], j
        groups.append(own)
        times.update((x[-1], y[-1]) for x, y in own)
    most = Counter()
    for (_, y), n in times.items():
        most[y] = max(most[y], n)
    rows = []
    for (ids_a, ids_b), own in zip(tokens, groups):
        counts = [(times[x[-1], y[-1]], most[y[-1]]) for x, y in own]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        rows.append((
            len(ids_a), len(ids_b), len(own), len(own), sum(n == top for n, top in counts),
            sum(n for n, _ in counts), hashlib.sha256(text.encode()).hexdigest() if own else "",
        ))
    return rows


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts_of_all_kinds():
    rng = random.Random(9)
    parts = [
        "a", " ", "  ", "\n", "\t", "é", "ß", "漢", "\U0001f642", "'s", "12", "2024", "…", "<s>", "</s>", "<unk>",
        "<0x41>", "<|endoftext|>", "the", "house", "Straße", "\x00", "½", "ﬁ", "\u200b", "--", "...", "aaaa", "\ufeff",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    return texts + ["x\u2581y", "\u2581", " ", "\n", "a" * 3000, "ab" * 700, prose(3, 2000), None, ""]


@pytest.mark.parametrize("hot_share", [1e-5, 0.02, 1.0])
def test_against_loops(spark, libraries, hot_share):
    texts = texts_of_all_kinds() + [text for _, text, *_ in odd_rows()]
    rows = documents(spark, [(i, text, "en", "a", 1) for i, text in enumerate(texts)]).repartition(3)
    settings = AlignSettings(hot_share=hot_share, portion=3000)
    out = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in
           token_alignment(with_clashes(rows), PATH_A, PATH_B, settings=settings).collect()}
    expected = plainly(texts, *libraries)
    for i, text in enumerate(texts):
        assert out[i] == expected[i], text
    assert len(out) == len(texts)
    assert out[texts.index("x\u2581y")] == (0, 0, 0, 0, 0, 0, "")
    assert any(0 < row[4] < row[3] for row in expected)


def test_odd_rows_and_no_rows(spark, libraries):
    out = token_alignment(documents(spark), PATH_A, PATH_B).collect()
    expected = plainly([text for _, text, *_ in odd_rows()], *libraries)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, ((r["doc_id"], *(r[n] for n in NAMES)) for r in out)), key=key) == sorted(
        ((row[0], *figures) for row, figures in zip(odd_rows(), expected)), key=key
    )
    assert token_alignment(documents(spark, []), PATH_A, PATH_B).collect() == []
    empty = documents(spark, [(1, None, "en", "a", 1), (2, "", "en", "a", 1)])
    assert {tuple(r) for r in token_alignment(empty, PATH_A, PATH_B).collect()} == {
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")
    }
