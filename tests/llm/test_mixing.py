from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from sievework.llm.mixing import MixSettings, copies, mix, mixed_documents, sizes, source_targets
from sievework.storage import materialise
from tests.llm.common import documents, odd_rows, prose, with_clashes, words


def brute_targets(size_of):
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + [None] * (None in size_of)
    weight = {name: (3, 1, 2)[i % 3] for i, name in enumerate(names)}
    left, target, open_ = 1.5 * sum(size_of.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * size_of[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size_of[s]
            left -= target[s]
        open_ -= full
    return target


def rows(n=600):
    names = ["a", "é", "Z", "b", None, "z"]
    return [(i, prose(i, 3 + i * 7 % 60), "en", names[min(i % 11, 5)], 1) for i in range(n)]


def test_targets_and_taken_words(spark):
    data = rows()
    out = mix(with_clashes(documents(spark, data)), settings=MixSettings(block=16)).collect()
    assert len(out) == len(data)
    size_of, longest, taken = Counter(), Counter(), Counter()
    for doc_id, text, _, source, _ in data:
        size_of[source] += len(words(text))
        longest[source] = max(longest[source], len(words(text)))
    target = brute_targets(size_of)
    for r in out:
        source = data[r["doc_id"]][3]
        assert r["size"] == len(words(data[r["doc_id"]][1])) and r["source_size"] == size_of[source]
        assert r["target"] == pytest.approx(target[source])
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[source] += r["taken"]
    for source in size_of:
        assert abs(taken[source] - target[source]) <= longest[source]


def test_same_mix_in_any_order(spark):
    data = rows()
    a = mix(documents(spark, data).repartition(3)).collect()
    b = mix(documents(spark, data[::-1]).repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in a} == {r["doc_id"]: r["taken"] for r in b}


def test_copies_keep_their_average(spark):
    data = [(i, prose(i, 10), "en", "ab"[i % 2], 1) for i in range(40)]
    sized = materialise(sizes(documents(spark, data), "doc_id", "text", "source"), "sizes")
    drawn = defaultdict(int)
    for seed in range(8):
        settings = MixSettings(weights=(5, 2), block=8, seed=seed)
        for r in copies(sized, source_targets(sized, settings), settings).collect():
            drawn[r["id"]] += r["copies"]
    # Source b takes six in seven of its 200 words; no document is always out.
    assert all(0 < drawn[i] for i in range(40))


def test_odd_rows(spark):
    out = mix(documents(spark)).collect()
    got = Counter((r["doc_id"], r["size"]) for r in out)
    assert got == Counter((i, len(words(t))) for i, t, *_ in odd_rows())
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert mix(documents(spark, [])).collect() == []
    nothing = documents(spark, [(1, None, None, "a", 1), (2, "", None, None, 1)])
    assert [(r["target"], r["taken"]) for r in mix(nothing).collect()] == [(0.0, 0), (0.0, 0)]


def test_documents_are_repeated_as_often_as_taken(spark):
    df = with_clashes(documents(spark, odd_rows() + [(100 + i, t, l, s, n) for i, t, l, s, n in rows(100)]))
    out = mixed_documents(df)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    got, expected = Counter(), Counter()
    for r in out.collect():
        got[(r["doc_id"], r["text"])] += 1
    for r in mix(df).collect():
        expected[(r["doc_id"], r["size"])] += r["copies"]
    by_size = Counter()
    for (doc_id, text), n in got.items():
        by_size[(doc_id, len(words(text)))] += n
    assert by_size == +expected
