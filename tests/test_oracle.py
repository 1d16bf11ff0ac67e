"""Every registered query of the engine against its SQL."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from sievelog.queries import QUERIES, SQL

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    done = con.execute(SQL[name])
    columns = [d[0] for d in done.description]
    assert sorted(columns) == sorted(got.columns)
    want = Counter(done.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["id", "status", "total", "customer"] and rows.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
