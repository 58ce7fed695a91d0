"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    place = [want.columns.index(c) for c in order]
    assert got == sorted(str([plain(r[i]) for i in place]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16 + 29 + 233 + 98 + 8
    assert set(e.oracle_sql()) <= set(e.queries())
