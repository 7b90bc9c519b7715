from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import jaccard_join as join
from sievework.operators.components import components
from sievework.llm.jaccard_join import JoinSettings, jaccard_components, keep_one_per_component
from tests.llm.common import documents, lower_az, odd_rows, prose, with_clashes, with_inner_clashes, words


def grams(text, k=5):
    found = words(lower_az(text or ""))
    if len(found) < k:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}


def brute(rows):
    sets = [(i, grams(text)) for i, text, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((str(i), len(x), str(root(i) if i is not None else None)) for i, x in sets)


def result(df, **options):
    return sorted(
        (str(r["doc_id"]), r["n_shingles"], str(r["component_id"]))
        for r in jaccard_components(df, **options).collect()
    )


def changed(text, rng, n):
    out = text.split(" ")
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def families(seed=1):
    """Near copies around the threshold, short texts that differ in a word at an
    end, a shared passage, and a chain."""
    rng, rows = random.Random(seed), []
    passage = prose(99, 30)
    for family in range(12):
        base = prose(family, rng.choice((6, 8, 12, 20, 60, 200)))
        rows += [changed(base, rng, rng.randrange(4)) for _ in range(6)]
        rows += [base + " tail", "head " + base, base.upper(), base.replace(" ", "\n ")]
        rows.append(f"{prose(500 + family, 25)} {passage} {prose(600 + family, 25)}")
    chain = prose(1234, 100).split(" ")
    for step in range(12):
        chain = chain[:-4] + [f"c{step}_{i}" for i in range(4)]
        chain = chain[4:] + chain[:4]
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    return [(i * 3 + 1, text, "en", "a", 1) for i, text in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = families(seed)
    assert result(with_clashes(documents(spark, rows))) == brute(rows)


@pytest.mark.parametrize("light", [0, 3, 12])
def test_any_boundary_gives_the_same(spark, monkeypatch, light):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 22))), "en", "a", 1) for i in range(150)]
    monkeypatch.setattr(join, "light_boundary", lambda *_: light)
    assert result(documents(spark, rows)) == brute(rows)


def test_a_large_group_of_near_copies_needs_few_pairs(spark, monkeypatch):
    rng, base = random.Random(8), prose(77, 120)
    rows = [(i, changed(base, rng, 1), "en", "a", 1) for i in range(300)]
    written = {}
    keep = join.materialise

    def counted(df, name):
        out = keep(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(join, "materialise", counted)
    assert result(documents(spark, rows)) == brute(rows)
    assert sum(written["pairs"]) < 300 * 30 < 300 * 299 / 2


def test_parities_never_say_more_than_is_apart():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, changes in ((1, 0), (5, 1), (40, 9), (300, 20), (300, 300), (5000, 500)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[changes:], rng.integers(0, 1 << 63, changes).astype(np.uint64))))
        both = join.parities(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])).to_pylist()
        bits = sum(bin((x ^ y) & ((1 << 64) - 1)).count("1") for x, y in zip(*both))
        apart = len(np.setxor1d(a, b))
        assert bits <= apart and bits % 2 == apart % 2 and (bits >= apart / 2 or apart > 500)


def test_unlike_texts_with_much_in_common_leave_few_pairs(spark, monkeypatch):
    """Texts that share half of their n-grams meet in many lists."""
    half = prose(5, 150)
    rows = [(i, f"{half} {prose(100 + i, 150)}", "en", "a", 1) for i in range(60)]
    written = []
    keep = join.materialise

    def counted(df, name):
        out = keep(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(join, "materialise", counted)
    assert result(documents(spark, rows)) == brute(rows)
    assert [n for name, n in written if name == "pairs"][-1] < 10


def test_odd_rows(spark):
    assert result(documents(spark)) == brute(odd_rows())
    assert result(documents(spark, [])) == []
    assert result(documents(spark, [(1, None, None, None, None)])) == [("1", 0, "1")]


def test_one_of_each_component_stays(spark):
    rows = families()
    df = with_inner_clashes(documents(spark, odd_rows() + [(i + 1000, *rest) for i, *rest in rows]))
    out = keep_one_per_component(df)
    assert out.columns == df.columns
    got = sorted(str(r["doc_id"]) for r in out.collect())
    expected = {i for i, _, root in result(df) if i == root and i != "None"}
    assert got == sorted([*expected, "None", "None"])


def test_components_of_a_long_chain_in_any_order(spark):
    rng = random.Random(2)
    names = list(range(400))
    rng.shuffle(names)
    edges = list(zip(names, names[1:])) + [(1000, 1001), (1001, 1000), (7, 7)]
    out = components(spark.createDataFrame(edges, "u long, v long")).collect()
    found = {r["node"]: r["root"] for r in out}
    assert found == {**{n: 0 for n in range(1, 400)}, 1001: 1000}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_bounds_of_sizes():
    s = JoinSettings()
    for n in range(1, 60):
        for m in range(n, 60):
            most = n  # all of the smaller set in common
            if 100 * most >= 80 * (n + m - most):
                assert m in join.sizes_of_partners(n, s)
                need = join.least_overlap(n, m, s)
                assert 100 * need >= 80 * (n + m - need) and 100 * (need - 1) < 80 * (n + m - need + 1)
                assert join.n_scanned(n, s) >= n - need + 1 and join.n_scanned(m, s) >= m - need + 1


def test_two_sets_meet_in_few_of_their_common_lists(spark):
    settings = JoinSettings()
    tokens = [f"w{i}" for i in range(300)]
    other = list(tokens)
    for i in range(30, 300, 45):
        other[i] = f"x{i}"
    # Not similar enough to link, yet too similar to be told apart by parities.
    df = spark.createDataFrame([(1, " ".join(tokens)), (2, " ".join(other))], "id long, text string")
    rows = join.with_keys(df, np.zeros(0, np.uint64), 0, settings).localCheckpoint()
    rest = F.expr("cast(n - greatest(pos - n_subsets, 0) as int)")
    members = rows.select("digest", "n", "n_subsets", F.posexplode("keys").alias("pos", "key")).select(
        "key", "digest", "n", rest.alias("rest"), F.col("digest").alias("root")
    )
    admitted = members.alias("a").join(members.alias("b"), "key").where(
        F.expr("a.digest < b.digest") & F.expr(join._may_overlap("a", "b", settings))
    )
    met = join._meetings(members, rows, settings)
    assert admitted.count() >= 15 and 1 <= met.count() <= 5 and met.distinct().count() == 1
