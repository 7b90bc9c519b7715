from __future__ import annotations

import hashlib
import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievework.config import EmbeddingSettings, NearDupSettings, ScoreSettings, SplitSettings
from sievework.functions import rules
from sievework.operators import reward, scoring, split, tagging
from sievework.operators.novelty import novelty_score

# The encoder below travels to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_length_score(apply):
    texts = [" ".join(["w"] * n) for n in (0, 4, 8, 40, 60, 80, 200)]
    assert apply(scoring.length_score, texts) == [0.0, 0.5, 1.0, 1.0, 0.5, 0.0, 0.0]


def test_score_and_flag_filters(spark):
    rows = [(100.0, True), (99.9, False), (None, None), (float("nan"), False)]
    df = spark.createDataFrame(rows, "score double, flag boolean")
    got = df.select(rules.has_min_score(F.col("score")), rules.is_unflagged(F.col("flag"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, True), (False, True)]


def test_relevance(spark):
    df = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "b", [0.0, 0.0]), (3, "z", [1.0, 1.0])], "i int, l string, v array<float>")
    score = scoring.relevance_score(F.col("v"), F.col("l"), ["a", "b"], np.array([[2.0, 0.0], [0.0, 1.0]]))
    assert {r["i"]: r["s"] for r in df.select("i", score.alias("s")).collect()} == {1: 0.6, 2: None, 3: None}


def test_novelty_by_buckets(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = [*base[:50], *[f"x{i}" for i in range(10)]]
    corpus = spark.createDataFrame(
        [("s", "1", " ".join(base), None), ("s", "2", " ".join(base) + "!", None)],
        "source string, source_id string, text string, score double",
    )
    asked = [("copy", " ".join(base)), ("near", " ".join(near)), ("new", "quite other words here"), ("none", "")]
    out = scoring.bucket_novelty_score(
        spark.createDataFrame(asked, "source_id string, text string"), corpus, near_dup=NearDupSettings(threshold=0.4)
    )
    got = {r["source_id"]: r["novelty"] for r in out.collect()}
    assert got == {"copy": 0.0, "near": round(1 - 48 / 68, 6), "new": 1.0, "none": 1.0}


def test_exact_novelty_meets_rows_that_the_buckets_miss(spark):
    """A row of similarity 0.41, far below the threshold, and a copy of a row that
    the near-duplicate step drops."""
    base = [f"w{i}" for i in range(60)]
    corpus = spark.createDataFrame(
        [("s", "1", " ".join(base), 2.0), ("s", "2", " ".join(["x", *base[1:]]), 1.0), ("s", "3", None, None)],
        "source string, source_id string, text string, score double",
    )
    asked = [("far", " ".join([*base[:36], *[f"y{i}" for i in range(24)]])), ("copy", " ".join(["x", *base[1:]])),
             ("new", "quite other words here"), ("none", ""), (None, None)]
    candidates = spark.createDataFrame(asked, "source_id string, text string")
    got = {r["source_id"]: r["novelty"] for r in novelty_score(candidates, corpus).collect()}
    assert got == {"far": round(1 - 34 / 82, 6), "copy": 0.0, "new": 1.0, "none": 1.0, None: 1.0}


@pytest.mark.parametrize("least_hot,hot_share", [(10**9, 1.0), (3, 1e-9), (20, 1e-9)])
def test_novelty_against_all_pairs(spark, least_hot, hot_share):
    """With a passage in a third of all rows, a shingle in most of them, copies,
    and candidates that share only such shingles with any row."""
    rng = random.Random(7)

    def prose(n, words=4000):
        return " ".join(f"w{rng.randrange(words)}" for _ in range(n))

    passage, common = prose(25), "in most of the rows"
    rows = [f"{prose(rng.randint(3, 30))} {common}" for _ in range(150)]
    rows += [f"{prose(rng.randint(1, 20), 50)} {passage} {prose(rng.randint(0, 20))}" for _ in range(80)]
    rows += rows[:20] + ["", None, "one", "one two", passage]
    asked = rows[:5] + [rows[160], rows[161] + " a few more words"]
    asked += [" ".join(rows[i].split()[2:] + [prose(3)]) for i in range(10, 40)]
    asked += [f"{prose(5)} {passage} {prose(40)}", f"{prose(30)} {common}", common, passage + " " + common, prose(40)]
    asked += [" ".join(passage.split()[3:12]) + " " + prose(5), "one", "two one", "", None]

    def grams(text):
        found = re.findall(r"\w+", (text or "").lower())
        return {tuple(found[i : i + 3]) for i in range(max(len(found) - 2, 1))} if found else set()

    sets = [g for g in map(grams, rows) if g]
    expected = {}
    for i, text in enumerate(asked):
        mine = grams(text)
        most = max((len(mine & g) / len(mine | g) for g in sets), default=0) if mine else 0
        expected[str(i)] = 0.0 if most >= 0.85 else round(1 - most, 6)
    candidates = spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "source_id string, text string")
    corpus = spark.createDataFrame([(t,) for t in rows], "text string")
    settings = ScoreSettings(least_hot=least_hot, hot_share=hot_share)
    got = {r["source_id"]: r["novelty"] for r in novelty_score(candidates, corpus, settings=settings).collect()}
    assert got == pytest.approx(expected, abs=1e-6)
    assert len(set(expected.values())) > 20


def test_novelty_of_nothing_and_against_nothing(spark):
    none = spark.createDataFrame([], "source_id string, text string")
    some = spark.createDataFrame([("a", "some words here"), ("a", "other words"), ("b", None)], none.schema)
    assert novelty_score(none, some).collect() == []
    assert {tuple(r) for r in novelty_score(some, none).collect()} == {("a", 1.0), ("b", 1.0)}
    assert {tuple(r) for r in novelty_score(some, some.limit(1)).collect()} == {("a", 0.0), ("b", 1.0)}


def test_group_relative_score_and_best(spark):
    rows = [("p", 1, 1.0), ("p", 2, 3.0), ("p", 3, 3.0), ("q", 1, 5.0)]
    df = spark.createDataFrame(rows, "prompt string, i int, s double")
    out = scoring.group_relative_score(df, ("prompt",), "s", ("i",)).collect()
    assert {(r["prompt"], r["i"], r["relative"], r["best"]) for r in out} == {
        ("p", 1, round(1 - 7 / 3, 6), False), ("p", 2, round(3 - 7 / 3, 6), True),
        ("p", 3, round(3 - 7 / 3, 6), False), ("q", 1, 0.0, True),
    }


def test_distinct_n(spark):
    df = spark.createDataFrame([("a", "x y x y"), ("a", "X"), ("b", ""), ("c", None)], "g string, text string")
    got = {(r["g"], r["n"]): (r["n_grams"], r["n_distinct"], r["distinct_share"]) for r in scoring.distinct_n(df, "g").collect()}
    assert got == {("a", 1): (5, 2, 0.4), ("a", 2): (3, 2, round(2 / 3, 6)), ("a", 3): (2, 2, 1.0)}


def test_arm_comparison(spark):
    df = spark.createDataFrame([("x", "c", 1.0), ("x", "d", 3.0), ("y", "c", 5.0)], "arm string, ctx string, s double")
    got = {(r["arm"], r["ctx"]): (r["n_rows"], r["mean_s"]) for r in scoring.arm_comparison(df, "arm", "ctx", ["s"]).collect()}
    assert got == {("x", "c"): (1, 1.0), ("x", "d"): (1, 3.0), ("y", "c"): (1, 5.0), ("x", None): (2, 2.0), ("y", None): (1, 5.0)}


def test_arms_side_by_side(spark):
    rows = [
        ("x", "c", "one two one", 1.0), ("x", "d", "one two three", 3.0), ("y", "c", "a b", None),
        ("x", "other", "not looked at", 9.0), ("z", "c", "no arm", 9.0), ("x", None, "no context", 9.0),
    ]
    df = spark.createDataFrame(rows, "who string, ctx string, body string, s double")
    out = scoring.compare_arms(df, "who", "ctx", ["s"], ["x", "y", "w"], ["c", "d", "e"], "body", (1, 2))
    assert out.columns == ["context", "metric", "x", "y", "w"]
    got = {(r["context"], r["metric"]): (r["x"], r["y"], r["w"]) for r in out.collect()}
    assert got[None, "n_rows"] == (2.0, 1.0, None) and got["d", "n_rows"] == (1.0, None, None)
    assert got[None, "mean_s"] == (2.0, None, None) and got["c", "mean_s"] == (1.0, None, None)
    assert got[None, "distinct_1"] == (0.5, 1.0, None) and got["c", "distinct_1"] == (round(2 / 3, 6), 1.0, None)
    assert got["d", "distinct_2"] == (1.0, None, None) and len(got) == 12


def letters_encoder():
    return lambda texts: np.array([[t.count(c) for c in "abc"] for t in texts], dtype=float)


def test_relevance_to_labels(spark):
    vectors = [([1.0, 0.0], "p"), ([3.0, 4.0], "q"), ([0.0, 0.0], "p"), ([1.0, 1.0], "none"), (None, "p"), ([1.0, 1.0], None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(vectors)], "i int, v array<double>, l string")
    score = scoring.relevance_score(F.col("v"), F.col("l"), ["p", "q"], np.array([[2.0, 0.0], [0.0, 5.0]]))
    assert [r["s"] for r in df.select("i", score.alias("s")).orderBy("i").collect()] == [1.0, 0.8, None, None, None, None]
    many = np.random.default_rng(1).random((2000, 64))
    plan = df.select(scoring.relevance_score(F.col("v"), F.col("l"), list(range(2000)), many))._jdf.queryExecution().toString()
    assert len(plan) < 5000

    texts = [("aab", "b"), ("abc", "zzz"), ("xyz", "a"), (None, "a"), ("", "a"), ("ccc", "c")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string, l string")
    settings = EmbeddingSettings(batch_size=2, label_prompt="{label}")
    near = reward.relevance_to_label(F.col("t"), F.col("l"), letters_encoder, ["a", "b", "c"], settings)
    got = [r["s"] for r in rows.select("i", near.alias("s")).orderBy("i").collect()]
    assert got == [round(1 / math.sqrt(5), 6), None, None, None, None, 1.0]


def test_all_five_parts_in_one_score(spark):
    rng = random.Random(6)
    labelled = []
    for i in range(200):
        found = [f"w{rng.randrange(40)}" for _ in range(10)] + [("good", "bad")[i % 2]]
        labelled.append((f"r{i}", " ".join(found), float(i % 2 == 0), float(i % 2)))
    df = spark.createDataFrame(labelled, "source_id string, text string, quality double, toxic double")
    quality = scoring.text_classifier(df.withColumnRenamed("quality", "label"), n_features=1 << 10)
    toxic = scoring.text_classifier(df.withColumnRenamed("toxic", "label"), n_features=1 << 10)
    asked = [("new", "good a b c and more new words here now", "a"), ("copy", labelled[0][1], "b"), ("bad", "bad c", "c"), (None, None, "a")]
    candidates = spark.createDataFrame(asked, "source_id string, text string, context string")
    out = reward.reward(
        candidates, df, quality, toxic, letters_encoder, labels=["a", "b", "c"], embedding=EmbeddingSettings(label_prompt="{label}"),
    ).collect()
    got = {r["source_id"]: r for r in out}
    assert set(got) == {"new", "copy", "bad", None} and got["copy"]["novelty"] == 0.0 and got["new"]["novelty"] == 1.0
    assert got["new"]["quality"] > 0.5 > got["bad"]["quality"] and got["new"]["clean"] > 0.5 > got["bad"]["clean"]
    assert got["bad"]["length"] == 0.25 and got["new"]["length"] == 1.0 and 0 < got["new"]["relevance"] < 1
    weights = ScoreSettings().weights
    for r in out:
        assert r["score"] == pytest.approx(sum(weights[name] * r[name] for name in reward.PARTS))


def test_classifier_on_texts_not_seen(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        found = [f"w{rng.randrange(50)}" for _ in range(12)]
        if i % 2:
            found[rng.randrange(12)] = rng.choice(("good", "fine"))
        rows.append((i, " ".join(found), float(i % 2)))
    df = spark.createDataFrame(rows, "i int, text string, label double")
    model = scoring.text_classifier(df.where("i < 300"), n_features=1 << 12)
    out = scoring.with_probability(df.where("i >= 300").union(spark.createDataFrame([(999, None, 0.0)], df.schema)), model, "p")
    got = {r["i"]: r["p"] for r in out.collect()}
    assert len(got) == 101 and all(0 <= p <= 1 for p in got.values())
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in range(300, 400)) > 95


def test_composite_score(spark):
    parts = {"quality": F.lit(1.0), "clean": F.lit(0.5)}
    assert spark.range(1).select(scoring.composite_score(parts)).first()[0] == pytest.approx(0.55)


def hashed(key, seed=42):
    return hashlib.md5(f"{seed}\x1f{key}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 4])
def test_samples_are_the_smallest_hashes(spark, monkeypatch, digits):
    """With one digit a step, the cut is looked for through several steps."""
    monkeypatch.setattr(split, "STEP_DIGITS", digits)
    sizes = {"a": 300, "b": 40, "c": 5, None: 60}
    rows = [(label, f"{label}{i}") for label, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "label string, id string")
    out = split.sample_per_label(df, 30, "label", ("id",)).collect()
    for label, n in sizes.items():
        want = sorted((f"{label}{i}" for i in range(n)), key=hashed)[:30]
        assert {r["id"] for r in out if r["label"] == label} == set(want)


def test_balanced_labels(spark):
    rows = [(label, f"{label}{i}") for label, n in {"a": 500, "b": 60, "c": 9}.items() for i in range(n)]
    df = spark.createDataFrame(rows, "label string, id string")
    assert Counter(r["label"] for r in split.balance_labels(df, "label", ("id",)).collect()) == {"a": 60, "b": 60, "c": 9}
    double = split.balance_labels(df, "label", ("id",), factor=2).collect()
    assert Counter(r["label"] for r in double) == {"a": 120, "b": 60, "c": 9}
    assert split.balance_labels(df.limit(0), "label", ("id",)).collect() == []


def test_approx_split(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"))
    out = split.approx_split(df, ("id",), SplitSettings(test_share=0.25))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    test = {r["id"] for r in out.where("split = 'test'").collect()}
    assert test == {str(i) for i in range(4000) if int(hashed(i)[:8], 16) < math.floor(0.25 * 2**32)}


def test_floor_sweep(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.2), ("b", 0.5)], "label string, similarity double")
    got = {tuple(r) for r in tagging.similarity_floor_sweep(df, (0.0, 0.5)).collect()}
    assert got == {("a", 0.0, 2), ("a", 0.5, 1), ("b", 0.0, 1), ("b", 0.5, 1)}


def test_novelty_makes_the_sets_once_per_task(spark, monkeypatch):
    from sievework.operators import novelty

    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(novelty, "materialise", seen)
    df = spark.createDataFrame([("a b c d",), ("?",), (None,)], "text string")
    assert [row["size"] for row in novelty._sets(df, "text", 3, "row").collect()] == [2]
    assert len(plans) == 1 and plans[0].count("ArrowEvalPython") == 1


def test_distinct_n_of_many_portions_and_groups(spark, monkeypatch):
    draw = random.Random(5)
    rows = [
        (draw.choice(["a", "b", None]), draw.choice([1.5, None]), " ".join(draw.choice("uvwxyz") for _ in range(draw.randrange(12))))
        for _ in range(300)
    ]
    monkeypatch.setattr(scoring, "PORTION", 40)
    df = spark.createDataFrame(rows, "g string, h double, text string").repartition(3)
    want = {}
    for g, h, text in rows:
        found = text.split()
        for n in (1, 2, 3):
            for i in range(len(found) - n + 1):
                want.setdefault((g, h, n), []).append(tuple(found[i : i + n]))
    got = {(r["g"], r["h"], r["n"]): (r["n_grams"], r["n_distinct"]) for r in scoring.distinct_n(df, ("g", "h")).collect()}
    assert got == {key: (len(grams), len(set(grams))) for key, grams in want.items()}


def test_distinct_n_shuffles_no_row_per_gram(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([("a", text)], "g string, text string")
    plan = scoring.distinct_n(df, "g")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan
    words = df.selectExpr("g", "transform(split(text, ' '), x -> xxhash64(x)) AS _words")
    assert 256 < scoring.gram_sets(words, ["g"], (1, 2, 3)).count() <= 3 * 256
