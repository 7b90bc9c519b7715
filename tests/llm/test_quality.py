from __future__ import annotations

import re
from collections import Counter
from dataclasses import replace

import pytest

from sievework.llm.quality import BASE, QualitySettings, judged, rule_order
from tests.llm.common import documents, odd_rows, prose, with_clashes, words


def figures(text):
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = list(zip(found, found[1:], found[2:]))
    times = Counter(windows)
    covered = {i + k for i, window in enumerate(windows) if times[window] > 1 for k in range(3)}
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered),
    )


def kept(text):
    n_words, n_chars, n_symbols, n_dup, n_repeat = figures(text)
    found, lines = words(text), [line for line in (text or "").split("\n") if words(line)]
    letters = sum(c.isalpha() for c in text or "")
    return not (
        n_words < 50 or 100 * n_repeat > 50 * n_words or 10 * n_symbols > n_words
        or n_chars < 2 * n_words or n_chars > 15 * n_words or 2 * n_dup > len(lines)
        or 2 * sum(any(c.isalpha() for c in w) for w in found) < n_words
        or 10 * sum(c.isupper() for c in text) > 7 * letters or 20 * len(set(found)) < n_words
    )


def samples():
    texts = [text for _, text, *_ in odd_rows()]
    texts += [
        "a b c a b c a b c", "x y z x y", "q " * 100, "one\ntwo\none\n \n\none", prose(4, 60).upper(),
        "\n".join([prose(5, 6)] * 30), prose(6, 60) + " $$$ %%% &&& ||| <<< >>> ###", "1 2 3 4 5 " * 3 + prose(8, 10),
        " ".join(str(i) for i in range(100)), "abcdefghijklmnopqrstuvwxyz" * 200 + " " + prose(9, 55),
        prose(10, 100) + " " + prose(10, 40), "a " * 5000 + prose(11, 200),
    ]
    return texts


@pytest.fixture(scope="module")
def rows(spark):
    return documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(samples())])


def test_against_brute_force(rows):
    out = {r["doc_id"]: r["_quality"] for r in judged(with_clashes(rows)).collect()}
    for i, text in enumerate(samples()):
        assert tuple(out[i][name] for name in BASE) == figures(text), text
        n_words, *_, n_repeat = figures(text)
        assert out[i]["base_failed"] == (n_words < 50 or 100 * n_repeat > 50 * n_words)
        assert out[i]["kept"] == kept(text), text
        assert (out[i]["failed_rule"] is None) == kept(text)


def test_a_text_of_a_million_words(spark):
    """Windows that are repeated here and there among a million that are not."""
    found = [f"w{i}" for i in range(1_000_000)]
    for at in range(1000, 990_000, 5000):
        found[at + 2000 : at + 2003] = found[at : at + 3]
    text = " ".join(found)
    out = judged(documents(spark, [(1, text, "en", "a", 1)])).first()["_quality"]
    assert out["n_repeat_words"] == figures(text)[-1] == 6 * len(range(1000, 990_000, 5000))


def test_a_small_share_still_has_rows(spark):
    from pyspark.sql import functions as F

    from sievework.llm.sampling import filled, in_share

    numbers = spark.range(2_000_000).select(F.xxhash64("id").alias("h"))
    found = numbers.where(in_share(F.col("h"), 1e-5)).count()
    assert 5 < found < 45
    assert numbers.where(in_share(F.col("h"), 2.0)).count() == 2_000_000
    lowest = numbers.agg(F.min("h")).first()[0]
    assert numbers.where(in_share(F.col("h"), (lowest + 2**63 + 1) / 2**64)).count() >= 1
    with pytest.raises(ValueError):
        filled(numbers.where("false"), 2_000_000, "a test")


def test_order_follows_rejections_per_work(rows):
    settings = QualitySettings()
    order = rule_order(rows, "text", settings)
    assert sorted(r.name for r in order) == sorted(r.name for r in settings.rules)
    dear = replace(settings, rules=tuple(
        replace(r, work="1000000") if r.name == order[0].name else r for r in settings.rules
    ))
    assert rule_order(rows, "text", dear)[0].name != order[0].name


def test_the_order_of_rules_does_not_change_what_is_kept(rows):
    settings = QualitySettings()
    turned = replace(settings, rules=settings.rules[::-1], sample_rows=1)
    def result(s):
        return sorted((r["doc_id"], r["_quality"]["kept"]) for r in judged(rows, settings=s).collect())

    assert result(settings) == result(turned)


def test_odd_rows_and_no_rows(spark):
    assert judged(documents(spark)).count() == len(odd_rows())
    assert judged(documents(spark, [])).collect() == []


def test_filter_does_not_work_out_figures_again(rows):
    plan = judged(rows).where("_quality.kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 1 * plan.count("Generate")
