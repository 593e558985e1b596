"""Every registered query of the engine runs, and agrees with its SQL."""

import glob
import os
from collections import Counter

import pytest

from loomgraph.plans.entry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def _norm(rows):
    def f(v):
        if isinstance(v, float):
            return "null" if v != v else repr(round(v, 5) + 0.0)
        return "null" if v is None else str(v)

    return Counter(tuple(map(f, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert _norm(df.select(*cols).collect()) == _norm(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    names = {"v0", "v1", "v2", "v3", "v4"}
    assert all({r.a, r.b} <= names and r.a != r.b and r.mark in (1, 2) for r in rows) and len({(r.a, r.b) for r in rows}) == len(rows)


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
