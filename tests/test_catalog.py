"""Each registered query against its SQL over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from sievework.plans.catalog import QUERIES, WITHOUT_SQL
from sievework.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) | set(WITHOUT_SQL)
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()


def test_entry(spark):
    assert entry(spark).count() == 7


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    ours = rows_of(df.columns, df.collect())
    result = duck.execute(oracle_sql()[name])
    assert ours == rows_of([c[0] for c in result.description], result.fetchall())
