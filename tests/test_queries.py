"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from babelyard.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf):
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return own


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, database, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name in oracles.SQL:
        expected = database.sql(oracles.SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_contract(spark, sf):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
