"""Two-view models: planted motions among wrong matches, degenerate groups, places that are no numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmesh.operators import twoview


def planted(model, n=120, wrong=60, seed=2):
    """Matches of points in space seen by two cameras (of one plane for a homography), and wrong ones."""
    rng = np.random.default_rng(seed)
    x = np.c_[rng.uniform(-2, 2, (n, 2)), np.full(n, 6.0) if model == "homography" else rng.uniform(4, 9, n)]
    c, s = np.cos(0.1), np.sin(0.1)
    y = x @ np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]]) + [0.6, 0.1, 0.0]
    view = lambda p: 800 * p[:, :2] / p[:, 2:] + 500
    good = np.c_[view(x), view(y)]
    return np.r_[good, rng.uniform(0, 1000, (wrong, 4))], n


@pytest.mark.parametrize("model", ["homography", "fundamental"])
def test_planted_motions_are_found(spark, model):
    p, n = planted(model)
    rows = [(k, f"m{i}", *map(float, r)) for k in (1, 2) for i, r in enumerate(p)]
    m = spark.createDataFrame(rows, "pair int, name string, xa double, ya double, xb double, yb double")
    got = twoview.verified(m, ["pair"], model).cache()
    true = got.where(F.substring("name", 2, 9).cast("int") < n)
    assert true.where("inlier").count() == 2 * n and true.agg(F.max("residual")).first()[0] < 1e-6
    assert got.count() == len(rows) and got.where("inlier").count() < 2 * n + 20
    assert {(r.pair, r.valid, r.passed) for r in twoview.gated(got, ["pair"]).collect()} == {(1, len(p), True), (2, len(p), True)}


def test_residuals_are_those_of_the_definition(spark):
    p, _ = planted("fundamental", 40, 10)
    m = np.random.default_rng(1).normal(size=(1, 3, 3))
    for model in twoview.MINIMAL:
        df = spark.createDataFrame([(*map(float, r), m.ravel().tolist()) for r in p], "xa double, ya double, xb double, yb double, matrix array<double>")
        got = [r[0] for r in df.select(twoview.residual(model)).collect()]
        want = twoview.residuals_of(m, p[:, :2], p[:, 2:], model)[0]
        for (xa, ya, xb, yb), g, w in zip(p, got, want):
            h = m[0] @ [xa, ya, 1]
            if model == "homography":
                plain = np.hypot(h[0] / h[2] - xb, h[1] / h[2] - yb)
            else:
                b = m[0].T @ [xb, yb, 1]
                plain = abs(np.dot([xb, yb, 1], h)) / np.sqrt(h[0] ** 2 + h[1] ** 2 + b[0] ** 2 + b[1] ** 2)
            assert g == pytest.approx(plain) and w == pytest.approx(plain)


def test_groups_without_a_model(spark):
    rows = [(1, 1.0, 1.0, 2.0, 2.0)] * 30 + [(2, float(i), float(i * i), float(i), float(i)) for i in range(3)] + [(3, None, float("nan"), 1.0, float("inf"))]
    m = spark.createDataFrame(rows, "pair int, xa double, ya double, xb double, yb double")
    got = twoview.verified(m, ["pair"], "homography")
    assert got.where("inlier").count() == 0 and got.where("residual is not null").count() == 0
    assert {tuple(r) for r in twoview.gated(got, ["pair"]).collect()} == {(1, 30, 0, False), (2, 3, 0, False), (3, 0, 0, False)}
    assert twoview.verified(m.limit(0), ["pair"]).count() == 0
