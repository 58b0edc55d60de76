"""Every named query against its SQL twin on the smallest data."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from inkveil.queries.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "events documents pages conversations orders customer labels benchmark region".split()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(
        (tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(SQL[name])
    want = normal([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
