"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyworks.plans import registry

DATA = "/root/testdata/sf0.001"


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(DATA):
        c.execute(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{n}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    o = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in o.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, o.fetchall())
