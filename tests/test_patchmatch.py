"""Slanted windows: planted planes are found, tiles do not show, missing pixels are passed over."""

import numpy as np

from fieldmesh.operators import patchmatch
from fieldmesh.operators.patchmatch import Search, slanted_disparities


def scene(seed, rows=36, cols=60):
    """A left image, and the right one under two slanted planes."""
    rng = np.random.default_rng(seed)
    right = rng.uniform(0, 255, (rows, cols + 30))
    right = (right + np.roll(right, 1, 1)) / 2
    r, c = np.indices((rows, cols))
    d = np.where(r < rows // 2, 4 + 0.08 * c / 2, 9 - 0.1 * (r - rows // 2) + 0.02 * c)
    x = c - d + 15
    low = np.floor(x).astype(int)
    left = right[r, low] * (1 - (x - low)) + right[r, low + 1] * (x - low)
    return left, right[:, 15 : 15 + cols], d


def frame(spark, left, right):
    return spark.createDataFrame([(int(r) - 7, int(c) + 5, float(left[r, c]), float(right[r, c])) for r, c in np.ndindex(left.shape)], "r long, c long, left double, right double").repartition(3)


def test_planted_planes_whatever_the_tiles(spark):
    left, right, d = scene(1)
    df = frame(spark, left, right)
    found = {}
    for tile in (64, 13):
        got = slanted_disparities(df, Search(0.0, 14.0, 0.2, 2, 40.0, tile), 3, 4).collect()
        found[tile] = {(r["r"] + 7, r["c"] - 5): (r["d"], r["cost"]) for r in got}
    assert found[64] == found[13] and len(found[64]) == left.size
    inner = [(r, c) for r, c in np.ndindex(left.shape) if abs(r - 18) > 3 and 3 < r < 32 and 14 < c < 55]
    good = sum(abs(found[64][p][0] - d[p]) < 0.25 for p in inner)
    assert good > 0.93 * len(inner)


def test_missing_pixels(spark):
    left, right, _ = scene(2, 12, 30)
    left[3, 4], right[5, :] = np.nan, np.nan
    got = slanted_disparities(frame(spark, left, right), Search(0.0, 14.0, 0.2, 2, 40.0, 16), 1, 1).collect()
    assert len(got) == left.size - 1 and all(np.isfinite(r["cost"]) for r in got)
    assert slanted_disparities(frame(spark, left, right).limit(0), Search(0.0, 5.0)).count() == 0


def test_half_sweeps_take_one_argument():
    """Spark gives a function of two arguments the group's key first."""
    import inspect

    assert len(inspect.signature(patchmatch._half_sweep(Search(0.0, 5.0), 1, 2)).parameters) == 1


def test_prices_do_not_hang_on_where_a_tile_begins():
    """The same pixels and planes, a column further on in the tile, cost the same to the last bit."""
    s = Search(0.0, 9.0, 0.3, 2, 40.0, 24)
    left, right, _ = scene(3, 24, 24)
    rng, cost = np.random.default_rng(4), []
    planes = np.stack([rng.uniform(0, 9, 60), *rng.uniform(-0.3, 0.3, (2, 60))])
    i, j = rng.integers(3, 20, (2, 60))
    for by in (0, 1, 5):
        t = patchmatch.Tile(np.full(patchmatch.Tile.size(s), np.nan).tobytes(), (0, 0), s)
        for image, x in ((t.left, left), (t.right, right)):
            image[s.radius : s.radius + 24, s.across + by : s.across + by + 24] = x
        cost.append(t.price(i, j + by, planes))
    assert np.isfinite(cost[0]).all() and (cost[0] == cost[1]).all() and (cost[0] == cost[2]).all()
