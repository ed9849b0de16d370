"""Every query with SQL equals DuckDB's rows on the same tables."""

from collections import Counter

import duckdb
import pytest

from meridix import catalog

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(repr(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, FOLDER)
    theirs = duck.sql(catalog.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, map(tuple, ours.collect())) == rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
