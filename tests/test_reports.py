from __future__ import annotations

import math
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.config import CurationConfig, SplitSettings
from sievework.operators import reports, select
from sievework.operators.split import stratified_split
from sievework.plans.clean import clean

SCHEMA = "source string, source_id string, text string, score double"


def split_of(spark, sizes, share=0.05, parts=4):
    rows = [(label, f"{label}{i}") for label, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "context string, id string").repartition(parts)
    return stratified_split(df, key=("id",), settings=SplitSettings(test_share=share)).collect()


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5])
def test_split_is_proportional_and_whole(spark, share):
    sizes = {"a": 400, "b": 101, "c": 21, "d": 20, "e": 19, "f": 1}
    rows = split_of(spark, sizes, share)
    total = sum(sizes.values())
    assert Counter(r["context"] for r in rows) == sizes
    test = Counter(r["context"] for r in rows if r["split"] == "test")
    assert sum(test.values()) == math.ceil(share * total)
    assert all(abs(test[label] - share * n) <= 1 for label, n in sizes.items())


def test_split_does_not_hang_on_partitioning(spark):
    one, many = (
        {(r["id"], r["split"]) for r in split_of(spark, {"a": 300, "b": 50}, parts=p)} for p in (1, 13)
    )
    assert one == many


def test_split_takes_the_smallest_hashes(spark):
    rows = split_of(spark, {"a": 500})
    import hashlib

    by_hash = sorted(rows, key=lambda r: hashlib.md5(f"42\x1f{r['id']}".encode()).hexdigest())
    assert [r["split"] for r in by_hash] == ["test"] * 25 + ["train"] * 475


def test_null_labels_are_a_label(spark):
    df = spark.createDataFrame([(None, str(i)) for i in range(40)], "context string, id string")
    out = stratified_split(df, key=("id",)).collect()
    assert Counter(r["split"] for r in out) == {"test": 2, "train": 38}


@pytest.mark.parametrize("n", [0, 1, 99, 100, 500, 1000, 2000])
def test_first_rows(spark, n):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("id"))
    got = select.first_rows(df, n, [F.col("id")])
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in got.collect()) == list(range(min(n, 1000)))


def test_top_n_by_score_puts_unscored_last(spark):
    df = spark.createDataFrame([("1", None), ("2", 5.0), ("3", 9.0), ("4", 5.0)], "source_id string, score double")
    for n, want in ((2, "23"), (3, "234"), (4, "1234"), (9, "1234")):
        assert sorted(r["source_id"] for r in select.top_n_by_score(df, n).collect()) == list(want)


def test_first_rows_among_equal_ones(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,), (0,)], "id int").repartition(3)
    got = [[r["id"] for r in select.first_rows(df, n, [F.col("id")]).collect()] for n in range(6)]
    assert [sorted(g, key=str) for g in got] == [
        [], [None], [0, None], [0, 1, None], [0, 1, 1, None], [0, 1, 1, 1, None]
    ]


def test_quantiles(spark):
    values = [1] * 700 + list(range(2, 302)) + [142_733]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "score double").repartition(5)
    row = reports.score_quantiles(df).first()
    cuts = statistics.quantiles(values, n=100, method="inclusive")
    assert (row["n_scored"], row["p50"], row["highest"]) == (1001, 1.0, 142_733)
    assert row["p90"] == pytest.approx(cuts[89]) and row["p95"] == pytest.approx(cuts[94])
    assert row["n_positive"] == sum(v >= 100 for v in values)


def test_distributions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "source string, score double")
    assert [tuple(r) for r in reports.source_distribution(df).collect()] == [("a", 2), ("b", 1)]
    assert reports.count_with_scores(df).first()[0] == 2
    assert {tuple(r) for r in reports.source_summary(df).collect()} == {("a", 2, 1), ("b", 1, 1), (None, 3, 2)}


def test_funnel_adds_up(spark):
    rows = [
        ("s", "1", "[removed]", 1.0), ("s", "2", None, None), ("s", "3", "too short", 1.0),
        ("s", "4", "one two three four five", 1.0), ("s", "5", "one two  three four five", 3.0),
        ("s", "6", "one two three four FIVE!", 2.0), ("s", "7", "an idiot in a text", 1.0),
        ("s", "8", "please upvote this good one", 1.0), ("s", "9", "my coffee is cold today", None),
        ("s", "10", "?!? !? ?? !!", 1.0),
    ]
    result = clean(spark.createDataFrame(rows, SCHEMA), CurationConfig(blocklist=("idiot",)))
    funnel = {r["stage"]: (r["dropped"], r["remaining"]) for r in result.funnel().collect()}
    assert funnel == {
        "dead_or_empty": (2, 8), "length": (1, 7), "exact_dup": (1, 6), "near_dup": (2, 4),
        "offensive": (1, 3), "meta": (1, 2), "final": (0, 2),
    }
    kept = {r["source_id"]: r["context"] for r in result.rows.collect()}
    assert kept == {"5": "general", "9": "coffee"}


def test_funnel_of_an_empty_corpus(spark):
    result = clean(spark.createDataFrame([], SCHEMA))
    assert result.rows.count() == 0
    assert sum(r["dropped"] + r["remaining"] for r in result.funnel().collect()) == 0
