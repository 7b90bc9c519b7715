"""Models that are learned: language model, language identification, toxicity."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import class_lm, language, ragged, toxicity
from tests.llm.common import documents, lower_az, odd_rows, prose, with_clashes, words


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_base_score_and_counts_by_brute_force(spark):
    rows = odd_rows() + [(100 + i, prose(i, 40).title(), "en", "a", 1) for i in range(60)]
    out = class_lm.scored(with_clashes(documents(spark, rows)), settings=class_lm.ModelSettings(head_words=50))
    tokens = [[*words(lower_az(t or "")), None] for _, t, *_ in rows]
    counts = Counter()
    for (i, *_), found in zip(rows, tokens):
        if i is not None and fold(i, 7) != 2:
            counts.update(found)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), i is not None and fold(i, 7) == 2, len(found), sum(counts[w] > 0 for w in found), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found), 5))
        for (i, *_), found in zip(rows, tokens)
    )
    got = out.collect()
    assert sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))
        for r in got
    ) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_scores_do_not_hang_on_how_many_words_are_joined(spark):
    df = documents(spark, [(i, prose(i, 60, 400), "en", "a", 1) for i in range(80)])

    def scores(head):
        settings = class_lm.ModelSettings(unit_words=40, shared_units=20, classes=8, head_words=head)
        return {r["doc_id"]: r["score"] for r in class_lm.scored(df, settings=settings).collect()}

    few, all_ = scores(45), scores(10_000)
    assert all(few[i] == pytest.approx(all_[i]) for i in few)


def test_classes_beat_the_base_on_texts_not_seen(spark):
    rows = [(i, prose(i, 80, 60, prefix="xy"[i % 2]), "en", "a", 1) for i in range(300)]
    out = [r for r in class_lm.scored(documents(spark, rows)).collect() if r["held_out"]]
    # Either half of the words is enough to know the other: about one bit a word.
    gain = sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out)
    assert gain > 0.2


@pytest.mark.parametrize("head", [25, 10_000])
def test_words_beyond_the_exchange_have_the_class_of_their_neighbours(spark, head):
    """All further words end alike, so only their neighbours tell them apart."""
    rng = random.Random(9)

    def text(own, far):
        return " ".join(f"{own}{rng.randrange(10)} {own}{rng.randrange(10)} {far}far{rng.randrange(30)}zz" for _ in range(20))

    rows = [(i, text("xy"[i % 2], "xy"[i % 2]), "en", "a", 1) for i in range(300)]
    held = [i for i in range(300, 400) if fold(i, 7) == 2][:10]
    rows += [(i, text("x", "xy"[i in held[5:]]), "en", "a", 1) for i in held]
    settings = class_lm.ModelSettings(unit_words=20, shared_units=5, classes=4, head_words=head)
    got = {r["doc_id"]: r["score"] for r in class_lm.scored(documents(spark, rows), settings=settings).collect()}
    assert min(got[i] for i in held[:5]) > max(got[i] for i in held[5:]) + 5


def test_exchange_parts_two_languages():
    rng = np.random.default_rng(1)
    pairs = np.zeros((20, 20))
    pairs[:10, :10] = rng.integers(5, 20, (10, 10))
    pairs[10:, 10:] = rng.integers(5, 20, (10, 10))
    of = class_lm.exchange(pairs, 2, 20)
    assert len(set(of[:10])) == len(set(of[10:])) == 1 and of[0] != of[10]


def test_language_model_without_training_rows(spark):
    assert class_lm.scored(documents(spark, [])).collect() == []
    row = class_lm.scored(documents(spark, [(None, "a b", None, None, None)])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 25])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) == {-1, 1}
    assert (np.abs(code.sum(axis=0)) < n).all()
    far = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(far) >= (code.shape[1] + 1) / 2 if n <= 7 else min(far) >= code.shape[1] / 4


LANGUAGES = {"en": "the of and to in is that it", "de": "der die und zu den das nicht von", "fr": "les des est que pour une dans et"}


def sentences(n):
    rng, rows = random.Random(3), []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        rows.append((i, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(rng.randrange(3, 40))), lang, "a", 1))
    return rows


def test_languages_of_texts_not_seen(spark):
    rows = sentences(400) + [(1000, None, "en", "a", 1), (1001, "12 34 !?", "en", "a", 1), (1002, "", "en", "a", 1)]
    df = with_clashes(documents(spark, rows))
    out = language.identified(df)
    assert out.columns == [*df.columns, "_language"]
    truth = {i: lang for i, _, lang, *_ in rows}
    got = {r["doc_id"]: r["_language"] for r in out.collect()}
    unseen = [i for i in truth if i < 1000 and got[i]["held_out"]]
    assert all(got[i]["held_out"] == (fold(i, 3) == 1) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in unseen) / len(unseen) > 0.97
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_a_text_in_two_languages_is_less_sure(spark):
    rows = sentences(400) + [(2000, f"{LANGUAGES['en']} {LANGUAGES['de']}", None, "a", 1), (2001, LANGUAGES["en"], None, "a", 1)]
    got = {r["doc_id"]: r["_language"]["score"] for r in language.identified(documents(spark, rows)).collect()}
    assert got[2000] < got[2001]


def test_language_of_odd_rows(spark):
    assert language.identified(documents(spark)).count() == len(odd_rows())
    assert language.identified(documents(spark, [])).collect() == []
    none = language.identified(documents(spark, [(1, "some words", None, "a", 1)])).first()["_language"]
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)


LABELS = "doc_id long, quality int, toxic int"


def labelled(n=600):
    rng, rows, labels = random.Random(6), [], []
    for i in range(n):
        found = prose(i, 60, 200).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                found[rng.randrange(len(found))] = rng.choice(("vile", "hateful", "nastyword"))
        rows.append((i, " ".join(found), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxic_texts_not_seen_are_found(spark):
    rows, labels = labelled()
    out = toxicity.toxicity(with_clashes(documents(spark, rows)), spark.createDataFrame(labels, LABELS)).collect()
    unseen = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in unseen} == {i for i, *_ in rows if fold(i, 5) == 0}
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in unseen)
    assert right / len(unseen) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_toxicity_of_odd_rows_and_odd_labels(spark):
    rows, labels = labelled(100)
    odd = [(None, 1, 1), (3, None, None), (5, 1, 1), (5, 1, 1), (4, 0, 7)]
    df = documents(spark, odd_rows() + [(100 + i, *rest) for i, *rest in rows])
    out = toxicity.toxicity(df, spark.createDataFrame(labels + odd, LABELS)).collect()
    assert len(out) == len(odd_rows()) + len(rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.toxicity(documents(spark), none).count() == len(odd_rows())
    assert toxicity.toxicity(documents(spark, []), none).collect() == []


def plain_models(texts):
    """Both interpolated models from dictionaries: P(word | before) and P(word)."""
    pairs = [Counter(), Counter()]
    for toxic, found in texts:
        pairs[toxic].update(zip(["<start>", *found], found))

    def discount(counts):
        n = Counter(counts.values())
        n1, n2, n3, n4 = (max(n[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        d = [0] + [min(max(d[i], 0.1), i - 0.01) for i in (1, 2, 3)]
        return lambda c: d[min(c, 3)]

    every = set(pairs[0]) | set(pairs[1])
    follows = Counter(w for _, w in every)
    d0 = discount(follows)
    even = sum(map(d0, follows.values())) / len(every) / (len(follows) + 1)

    def shared(w):
        return max(follows[w] - d0(follows[w]), 0) / len(every) + even

    def alone(k, w):
        own = Counter(x for _, x in pairs[k])
        d, size = discount(own), len(pairs[k])
        return max(own[w] - d(own[w]), 0) / size + sum(map(d, own.values())) / size * shared(w)

    def after(k, v, w):
        d, here = discount(pairs[k]), [n for (x, _), n in pairs[k].items() if x == v]
        if not here:
            return alone(k, w)
        n = pairs[k][v, w]
        return max(n - d(n), 0) / sum(here) + sum(map(d, here)) / sum(here) * alone(k, w)

    return alone, after


def test_both_likelihoods_by_dictionaries(spark):
    rng = random.Random(12)
    texts = [(int(i % 3 == 0), [f"w{int(rng.expovariate(0.15))}" for _ in range(25)]) for i in range(40)]
    rows = spark.createDataFrame([(bool(t), " ".join(found)) for t, found in texts], "toxic boolean, text string").repartition(3)
    model = toxicity.ToxicModel(toxicity.pair_counts(rows).toPandas(), toxicity.ToxicSettings())
    alone, after = plain_models(texts)
    asked = [found for _, found in texts[:6]] + [["never", "w1", "never", "seen", "w3", "w0"], [], ["w2"]]
    column = pa.array([" ".join(found) for found in asked])
    words = toxicity.Words(*ragged.text_bytes(column))
    pair, word = model.ratios(words)
    expected = [
        (math.log(after(1, v, w) / after(0, v, w)), math.log(alone(1, w) / alone(0, w)))
        for found in asked for v, w in zip(["<start>", *found], found)
    ]
    assert len(pair) == len(expected)
    assert np.allclose(pair, [a for a, _ in expected], atol=1e-5) and np.allclose(word, [b for _, b in expected], atol=1e-9)
    # Each model is a distribution over all words and one that is not known.
    known = sorted({w for _, found in texts for w in found})
    for k in (0, 1):
        assert sum(alone(k, w) for w in [*known, "unknown"]) == pytest.approx(1)
        assert sum(after(k, "w1", w) for w in [*known, "unknown"]) == pytest.approx(1)


def test_words_that_both_classes_hardly_know_say_little(spark):
    texts = [(i % 2, [f"w{(i * 7 + j) % 30}" for j in range(20)]) for i in range(60)]
    texts[0] = (0, [*texts[0][1], "rare"])
    rows = spark.createDataFrame([(bool(t), " ".join(f)) for t, f in texts], "toxic boolean, text string")
    model = toxicity.ToxicModel(toxicity.pair_counts(rows).toPandas(), toxicity.ToxicSettings())
    words = toxicity.Words(*ragged.text_bytes(pa.array(["rare unseen"])))
    assert (np.abs(model.ratios(words)[1]) < 1.5).all()
