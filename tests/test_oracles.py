"""Every query that has SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from archlens.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, bool) or x is None:
            return x
        if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
            return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
        return str(x)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns


def test_all_have_rows(spark):
    assert QUERIES["q_dependents"](spark, DATA).count() > 0
