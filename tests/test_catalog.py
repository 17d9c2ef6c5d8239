"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenfold import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    rel = con.execute(catalog.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at[c]]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 for x, y in zip(a, b)), (a, b)
