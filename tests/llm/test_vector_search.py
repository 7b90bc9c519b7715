from __future__ import annotations

import math
import random

import pytest

from sievework.llm.vector_search import SearchSettings, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    import numpy as np

    # Each row is a candidate, and each different query is answered once.
    data = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v, _ in rows if i is not None and ok(v)]
    out = []
    for query, q in set(data):
        if query % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in data if i != query)[:k]
            out += [(query, rank, i, -score) for rank, (score, i) in enumerate(found, 1)]
    return sorted(out)


def result(df, **options):
    return sorted(tuple(r) for r in top_k(df, settings=SearchSettings(**options)).collect())


def vectors(n, seed=1, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 2) for _ in range(dim)] for _ in range(5)]
    return [(i, [rng.gauss(c, 0.2) for c in rng.choice(centres)], 0) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"n_pivots": 3, "n_query_groups": 2, "queries": 4, "vectors": 50}])
def test_against_all_pairs(spark, options):
    rows = vectors(300)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS cell", "4 AS d")
    assert result(df, **options) == brute(rows)


def test_a_common_vector_and_ties(spark):
    rows = vectors(120) + [(1000 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(200)]
    rows += [(2000, [0.0] * 6, 0), (2020, [-1.0] * 6, 0)]
    assert result(spark.createDataFrame(rows, SCHEMA), vectors=60) == brute(rows)


def test_an_id_of_many_vectors_leaves_the_others(spark):
    """More of the query's own vectors than k score higher than any candidate."""
    rng = random.Random(8)
    rows = [(20, [50.0 + rng.gauss(0, 0.1), 50.0], 0) for _ in range(40)]
    rows += [(1 + i % 19 + 100 * i, [1.0 + rng.gauss(0, 0.1), 1.0], 0) for i in range(60)]
    # As in SQL, the vectors of an id are ranked together.
    every = sorted((-score, i) for _, _, i, score in brute(rows, 3))[:3]
    expected = [(20, rank, i, -score) for rank, (score, i) in enumerate(every, 1)]
    assert result(spark.createDataFrame(rows, SCHEMA), n_pivots=16, k=3) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0),
        (None, [1.0, 1.0], 0), (20, [3.0, -1.0], None), (5, [0.5, 0.5], 0), (5, [0.5, 0.5], 0), (40, [0.015, 0.0], 0),
    ]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(20, [1.0], 0)], SCHEMA)) == []


def test_repeated_rows_are_candidates_as_often_as_they_are_there(spark):
    rows = vectors(60)
    rows += [(107, [2.0] * 6, 0)] * 3 + [(109, [2.0] * 6, 0)] * 30 + [rows[20]] * 2 + [rows[33]] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df) == brute(rows)
    assert result(df, k=4, n_pivots=5) == brute(rows, 4)


def test_pruning_copies_less_than_everything(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        far = [0.0] * 8
        far[i % 8] = 40.0
        rows.append((i, [x + rng.gauss(0, 0.1) for x in far], 0))
    plan = top_k(spark.createDataFrame(rows, SCHEMA), settings=SearchSettings(n_pivots=16, n_query_groups=8))
    assert sorted(tuple(r) for r in plan.collect()) == brute(rows)
