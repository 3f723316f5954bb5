"""All registered queries run on the smallest tables and agree with their SQL there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

D = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return con


def norm(v):
    return "" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        rel = db.sql(SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
