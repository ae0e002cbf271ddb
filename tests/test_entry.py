"""The entry points, and every query with SQL against DuckDB on the smallest tables."""

import math
import os
import threading

import duckdb
import pytest

import __spark_entry__ as entry
from fieldmesh.plans import catalog

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(AT), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, AT)
    stop = threading.Timer(60, con.interrupt)  # SQL without an end must not stop the run
    stop.start()
    want = con.sql(catalog.ORACLES[name])
    fetched = want.fetchall()
    stop.cancel()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in fetched), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and abs(p - q) < 2e-4) for p, q in zip(x, y)), (x, y)
