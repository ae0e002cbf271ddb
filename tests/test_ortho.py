"""Orthophotos: a planted wall hides what lies behind it; nearby images only; blending."""

import pytest

from fieldmesh.operators import ortho

SCHEMA = "image string, cx double, cy double, cz double, " + ", ".join(f"{m} double" for m in ortho.TURN) + ", radius double"
DOWN = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)  # x to the right, looking down


def test_a_wall_hides_what_lies_behind(spark):
    cells = spark.createDataFrame([(r, c, 20.0 if c == 30 else 0.0) for r in range(20) for c in range(60)], "r long, c long, z double")
    images = spark.createDataFrame([("left", 10.0, 10.0, 50.0, *DOWN, 45.0), ("right", 50.0, 10.0, 50.0, *DOWN, 45.0), ("far", 500.0, 10.0, 50.0, *DOWN, 45.0)], SCHEMA)
    got = ortho.visible(cells, images, 100.0, 300.0, 300.0, 2.0, 1.0, 0.5).collect()
    by = {i: {(r["r"], r["c"]) for r in got if r["image"] == i} for i in ("left", "right", "far")}
    assert not by["far"]
    # from 10 the wall's top at 30 (20 high, seen from 50) casts its shadow to 10 + 20 * 50 / 30 = 43.3
    for c in (31, 35, 40, 42):
        assert (10, c) not in by["left"] and (10, c) in by["right"]
    for c in (0, 10, 20, 28, 30, 45, 50):
        assert (10, c) in by["left"]
    for c in (18, 22, 26, 29):
        assert (10, c) not in by["right"] and (10, c) in by["left"]
    pixels = spark.createDataFrame([(r["image"], r["pu"], r["pv"], 1.0 if r["image"] == "left" else 3.0) for r in got], "image string, pu long, pv long, value double").distinct()
    found = spark.createDataFrame(got)
    mixed = {(r["r"], r["c"]): (r["value"], r["images"]) for r in ortho.blended(found, pixels, cells).collect()}
    assert len(mixed) == 1200 and mixed[10, 35] == (3.0, 1) and mixed[10, 25] == (1.0, 1) and mixed[10, 30] == (pytest.approx(2.0), 2)
    assert ortho.visible(cells.limit(0), images, 100.0, 300.0, 300.0, 2.0, 1.0, 0.5).count() == 0
    assert ortho.visible(cells, images.limit(0), 100.0, 300.0, 300.0, 2.0, 1.0, 0.5).count() == 0
