"""The queries that have SQL, against DuckDB."""

import glob
import os
from collections import Counter

import pytest

from loomgraph.llm.entry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def _norm(rows):
    return Counter(tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert _norm(df.select(*cols).collect()) == _norm(want)
