"""Every query that has SQL gives what the SQL gives, over the smallest tables; the others run."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from folioscope.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(DATA).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    rel = duck.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(rel.columns) == sorted(df.columns)
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    key = lambda r: repr(r)
    assert sorted(map(plain, got), key=key) == sorted(map(plain, want), key=key)


def test_entry(spark):
    assert set(entry.entry(spark).columns) >= {"qid", "mrr"}
