from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sievework.llm.lexical_search import SearchSettings, lengths_of, lexical_search
from sievework.llm.queries import ORACLES
from tests.llm.common import documents, lower_az, odd_rows, prose, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall(lower_az(text or ""))


def plainly(rows, items, most=10):
    """All answers as (item, rank, document, score), pair by pair."""
    counts = [(row[0], Counter(terms(row[1]))) for row in rows]
    n_documents = sum(bool(c) for _, c in counts)
    n_terms = sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, c in counts:
            score = 0
            for term in set(terms(text)):
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding[term] + 1)))
                    m = 100 - 90 + (90 * sum(c.values()) * n_documents) // n_terms
                    score += weight * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(found)[:most], 1):
            out.append((item, rank, doc_id, -score))
    return out


def got(answers):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in answers.collect()]


def same(a, b):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


def many_rows():
    rng = random.Random(8)
    rows = [(i, prose(i % 90, rng.randint(1, 120), 400), "en", "a", 1) for i in range(600)]
    # Equal texts that tie at the last place, in no order of their ids.
    rows += [(10_000 - 7 * i, "tie of w1 w2, W3", "en", "a", 1) for i in range(200)]
    rows += [(20_000 + i, "Été ÉTÉ x_y a-b 漢字 " + prose(i, 4), "fr", "b", 1) for i in range(40)]
    rng.shuffle(rows)
    return rows + odd_rows()


def some_items():
    items = [(i, prose(1000 + i, 12, 400)) for i in range(70)]
    return items + [
        (500, "w1 W2 w3 tie"), (501, "w1 w1 w1"), (502, "été x y 漢字"), (503, None), (504, "?! ,"), (505, "nothing-of-it"),
        (506, "w5"), (506, "w5"), (None, "w6 w7"), (507, prose(5, 900, 400)),
    ]


@pytest.mark.parametrize("settings", [
    SearchSettings(), SearchSettings(block_terms=500, item_tile=3, term_tile=5, document_tile=7, parts=2),
])
def test_against_pair_by_pair(spark, settings):
    rows, items = many_rows(), some_items()
    docs = with_clashes(documents(spark, rows)).repartition(5)
    asked = with_clashes(spark.createDataFrame(items, ITEMS))
    same(got(lexical_search(docs, asked, settings=settings)), plainly(rows, items))


def test_ties_are_by_id(spark):
    rows = [(i, "a b c", "en", "a", 1) for i in range(500, 0, -1)] + [(1000, "x", "en", "a", 1)]
    answers = got(lexical_search(documents(spark, rows).repartition(4), spark.createDataFrame([(1, "a c")], ITEMS)))
    assert [a[2] for a in sorted(answers, key=lambda a: a[1])] == list(range(1, 11))
    assert len({a[3] for a in answers}) == 1


def test_no_rows(spark):
    some = spark.createDataFrame([(1, "a"), (2, None)], ITEMS)
    assert got(lexical_search(documents(spark, []), some)) == []
    assert got(lexical_search(documents(spark), spark.createDataFrame([], ITEMS))) == []
    blank = documents(spark, [(1, None, "en", "a", 1), (2, " ?", "en", "a", 1)])
    assert got(lexical_search(blank, some)) == []


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**7, 3 * 10**9])
    expected = [10 + 90 * int(x) * 4 * 10**10 // (4 * 10**13) for x in n]
    assert lengths_of(n, 4 * 10**10, 4 * 10**13, SearchSettings()).tolist() == expected


def test_sql_of_the_query_says_the_same(spark, tmp_path):
    rows, items = [r for r in many_rows() if r[0] is not None], [i for i in some_items() if i[0] not in (None, 506)]
    documents(spark, rows).dropDuplicates().write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    result = duck.execute(ORACLES["op11_lexical_search"])
    names = [c[0] for c in result.description]
    theirs = [tuple(row[names.index(n)] for n in ("item_id", "rank", "doc_id", "score")) for row in result.fetchall()]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    same(got(lexical_search(docs, spark.createDataFrame(items, ITEMS))), theirs)
