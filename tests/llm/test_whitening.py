"""Whitening against exact integers and a plain eigensolver, and on odd tables."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("fieldmesh.llm")
from fieldmesh.llm import whitening  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    off = np.array([[float(Fraction(int(a)) - Fraction(int(s), n)) for a, s in zip(row, sums)] for row in x])
    value, vector = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-value)[:8]
    return n, deviation, off @ vector[:, order] / np.sqrt(value[order]), value[order] / value.sum()


def test_whitening_is_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12)) @ np.diag(np.geomspace(2, 0.05, 12)) + 30
    n, deviation, white, explained = brute(v)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], SCHEMA).repartition(5)
    got = whitening.whitened(df).collect()
    assert len(got) == 300 * 8 and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    mine = np.zeros((300, 8))
    for r in got:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and abs(r["explained"] - explained[r["component"] - 1]) < 1e-10
        mine[r["vec_id"], r["component"] - 1] = r["whitened"]
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-7
    assert np.abs(mine.T @ mine / n - np.eye(8)).max() < 1e-9


def test_deviations_beyond_64_bits():
    c = whitening.Centre(3, [3 * 2**61, 6, 1])
    x = np.array([[2**61 + 5, 2, 0], [2**61, 2, 1], [2**61 - 5, 2, 0]])
    assert c.deviation(x) == [15**2 + 1, 4, 15**2 + 1]
    assert whitening.Centre(2**30, [0] * 3).deviation(np.array([[2**31, 0, 0], [2, 0, 0]])) == [None, 4 * 2**60]


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, nan]), (3, [inf, 1.0]), (4, [None, 2.0]), (5, [1.0, 2.0, 3.0]), (6, []), (7, [3e38, 1.0])]
    good = [(10, [1.0, 2.0]), (10, [1.0, 2.0]), (None, [2.0, 2.5]), (12, [0.5, -1.0])]
    df = spark.createDataFrame(rows + good, SCHEMA).withColumns({c: F.lit(c) for c in ("v", "n", "d", "blob", "component")})
    got = whitening.whitened(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["10"] * 4 + ["None"] * 2 + ["12"] * 2)
    n, deviation, _, _ = brute([v for _, v in good])
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, d) for (i, _), d in zip(good, deviation)} and got[0]["n"] == n
    for same in ([], [(1, [])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.whitened(spark.createDataFrame(same, SCHEMA)).count() == 0
