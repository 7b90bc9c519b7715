from __future__ import annotations

import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievework import lexicons
from sievework.config import EmbeddingSettings
from sievework.operators import reports, tagging

# The encoders below travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_obvious_contexts(apply):
    # Two keywords of one label outweigh one of another.
    names = [label for label, _ in lexicons.CONTEXT_KEYWORDS]
    texts = [f"{kws[0]} and {kws[0]}, {kws[-1]}" for _, kws in lexicons.CONTEXT_KEYWORDS]
    assert apply(tagging.tag_by_keywords, [*texts, "zzz qqq vvv", ""]) == [*names, "", ""]


def test_ties_go_to_the_earlier_label(apply):
    (a, first), (b, second) = lexicons.CONTEXT_KEYWORDS[0], lexicons.CONTEXT_KEYWORDS[1]
    texts = [f"{second[0]} {first[0]}", f"{first[0]} {second[0]}", second[0]]
    assert apply(tagging.tag_by_keywords, texts) == [a, a, b]


def test_prefix_matching(apply):
    assert apply(tagging.tag_by_keywords, ["category"]) == ["animals"]


def test_every_keyword_label_is_declared():
    assert {label for label, _ in lexicons.CONTEXT_KEYWORDS} < set(lexicons.LABELS)


@pytest.mark.parametrize("keywords", [
    lexicons.CONTEXT_KEYWORDS,
    (("one", ("date night", "date")), ("two", ("night club", "club"))),
])
def test_hits_equal_a_count_per_label(apply, keywords):
    texts = [
        "final exam, final exams and exam", "ex-wife in-laws wife", "rock band band", "date night club club",
        "studying study student", "Credit Card credit", "DOG cat.dog/cat",
    ]
    want = [
        [len(re.findall(r"\b(?:" + "|".join(map(re.escape, kws)) + ")", t, re.I)) for _, kws in keywords]
        for t in texts
    ]
    assert apply(lambda t: tagging.keyword_hits(t, keywords), texts) == want


def test_whole_word_hits_equal_a_count_per_label(apply):
    keywords = (("one", ("date night", "date", "cat")), ("two", ("night club", "club", "the cat")), ("three", ("cat",)))
    texts = ["category cat", "date night club club", "dates the cat", "the cat, the cats", "date night", ""]
    want = [
        [len(re.findall(r"\b(?:" + "|".join(sorted(map(re.escape, kws), key=len, reverse=True)) + r")(?!\w)", t)) for _, kws in keywords]
        for t in texts
    ]
    assert apply(lambda t: tagging.keyword_hits(t, keywords, "word"), texts) == want
    marked = (("one", ("cat ",)), ("two", ("cat",)))
    assert apply(lambda t: tagging.keyword_hits(t, marked, "marked"), ["category cat"]) == [[1, 2]]
    assert apply(lambda t: tagging.tag_by_keywords(t, keywords, "word"), ["category", "the cat"]) == ["", "one"]


def axis_encoder():
    """Three axes: a, b, c; a text is the sum of the axes it names."""
    return lambda texts: np.array([[t.count(ch) for ch in "abc"] for t in texts], dtype=float)


SETTINGS = EmbeddingSettings(floor=0.8, batch_size=2, label_prompt="{label}")


def test_nearest_label_floor_and_order(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    vectors = np.array([[1.0, 0.0], [0.0, 1.0]])
    near = tagging.nearest_label(F.col("v"), ["x", "y"], vectors, floor=0.6)
    got = {r["i"]: r["n"] for r in df.select("i", near.alias("n")).collect()}
    assert [got[i]["label"] for i in range(6)] == ["x", "y", "x", "general", None, "general"]
    at_floor = tagging.nearest_label(F.col("v"), ["x"], vectors[:1], floor=0.6)
    exact = {r["i"]: r["n"] for r in df.select("i", at_floor.alias("n")).collect()}
    assert exact[1]["label"] == "x"


def test_labels_are_bounded():
    with pytest.raises(ValueError):
        tagging.nearest_label(F.lit(None), [], np.zeros((0, 2)))


def test_two_pass_encodes_only_untagged_rows(spark):
    def encoder():
        def encode(texts):
            assert not any("coffee" in t for t in texts)
            return axis_encoder()(texts)

        return encode

    df = spark.createDataFrame([(0, "coffee aaa"), (1, "aaaa"), (2, "bbb"), (3, "abc")], "i int, text string")
    out = tagging.tag_two_pass(
        df, keywords=(("coffee", ("coffee",)),), make_encoder=encoder, labels=("a", "b", "general"),
        settings=SETTINGS,
    )
    assert [r["context"] for r in out.orderBy("i").collect()] == ["coffee", "a", "b", "general"]


def test_without_encoder_the_rest_is_general(spark):
    df = spark.createDataFrame([(0, "coffee"), (1, "qqq")], "i int, text string")
    out = tagging.tag_two_pass(df).orderBy("i").collect()
    assert [r["context"] for r in out] == ["coffee", "general"]


def test_encode_texts_passes_nulls(spark):
    df = spark.createDataFrame([(0, "ab"), (1, None), (2, "cc")], "i int, t string")
    out = df.select("i", tagging.encode_texts(F.col("t"), axis_encoder, 1).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in out] == [[1, 1, 0], None, [0, 0, 2]]


def test_coverage_and_precision(spark):
    rows = [("coffee", "coffee time"), ("coffee", "a bar joke"), ("food", "pizza"), ("general", "x"), ("", "y")]
    df = spark.createDataFrame(rows, "context string, text string")
    assert tuple(reports.tag_coverage(df).first()) == (4, 5, 80.0)
    report = {r["context"]: (r["n_rows"], r["percent_confirmed"]) for r in reports.tag_precision_report(df).collect()}
    assert report == {"coffee": (2, 50.0), "food": (1, 100.0)}


def counting_encoder():
    """Notes each time an encoder is made, in a file of its own."""
    import os
    import uuid

    open(os.path.join(os.environ["ENCODER_NOTES"], f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
    return lambda texts: np.ones((len(texts), 2))


def test_an_encoder_is_made_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os

        os.environ["ENCODER_NOTES"] = folder
        return counting_encoder()

    df = spark.range(64, numPartitions=16).select(F.col("id").cast("string").alias("t"))
    df.select(tagging.encode_texts(F.col("t"), make)).collect()
    made = [path.name.split("-")[0] for path in tmp_path.iterdir()]
    assert 1 <= len(made) == len(set(made)) <= 8 < 16


def test_precision_report_encodes_once(spark):
    df = spark.createDataFrame([("coffee", "x")], "source_id string, text string")
    tagged = tagging.tag_two_pass(df, make_encoder=axis_encoder, labels=("a", "b", "general"))
    plan = reports.tag_precision_report(tagged)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_centroids_of_declared_labels(spark):
    rows = [("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [0.0, 1.0]), ("c", [9.0, 9.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "label string, v array<float>")
    names, means = tagging.label_centroids(df, "label", "v", ["b", "a", "never"])
    assert names == ["b", "a"] and means.tolist() == [[0.0, 1.0], [2.0, 4.0]]
