"""Every query of this subpackage that has SQL gives what the SQL gives, over the smallest tables; the others run."""

import pytest

import __spark_entry__ as entry
from folioscope.llm import queries
from test_entry import duck, plain, pytestmark  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    if (sql := entry.oracle_sql().get(name)) is None:
        return
    rel = duck.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(rel.columns) == sorted(df.columns)
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert sorted(map(plain, got), key=repr) == sorted(map(plain, want), key=repr)
