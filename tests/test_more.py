"""Dense tables, plans and text formats on small inputs."""

import pytest
from pyspark.sql import functions as F

from fieldmesh.operators import dense, planning
from fieldmesh.sources import formats, writers


def test_path_costs_against_a_loop(spark):
    rows = [(r, c, d, float((r * 7 + c * 5 + d * 3) % 11)) for r in range(2) for c in range(6) for d in range(4)]
    got = {(x["r"], x["c"], x["d"]): x["total"] for x in dense.path_costs(spark.createDataFrame(rows, "r long, c long, d long, cost double"), 1.0, 3.0).collect()}
    cost = {(r, c, d): v for r, c, d, v in rows}
    for r in range(2):
        before = [cost[r, 0, d] for d in range(4)]
        for c in range(1, 6):
            best = min(before)
            before = [cost[r, c, d] + min([before[d], best + 3.0] + [before[e] + 1.0 for e in (d - 1, d + 1) if 0 <= e < 4]) - best for d in range(4)]
            assert [got[r, c, d] for d in range(4)] == pytest.approx(before)


def test_speckles(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.2), (0, 2, 9.0), (1, 0, 1.1)], "r long, c long, d double")
    assert sorted((x["r"], x["c"]) for x in dense.speckles(cells, 0.5, 3).collect()) == [(0, 0), (0, 1), (1, 0)]


def test_fused_takes_the_upper_median(spark):
    d = spark.createDataFrame([(0, 0, v) for v in (1.0, 2.0, 3.0, 4.0)], "r long, c long, depth double")
    assert dense.fused(d).first()["depth"] == 3.0


def test_blocks_are_balanced(spark):
    e = spark.createDataFrame([(i, i + 1, 10 - i) for i in range(9)], "a long, b long, n long")
    sizes = sorted(r["count"] for r in planning.balanced_blocks(e, 4).groupBy("block").count().collect())
    assert sum(sizes) == 10 and len(sizes) == 3 and max(sizes) <= 4


def test_cycles_are_not_admitted(spark):
    tasks = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "task long")
    needs = spark.createDataFrame([(2, 1), (3, 4), (4, 3), (5, 4)], "task long, need long")
    assert sorted(map(tuple, planning.admissible(tasks, needs).collect())) == [(1, 0), (2, 1)]


def test_ply_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0.5, 1.0, 2.0), (3.0, 4.0, 5.0)], "x double, y double, z double")
    assert writers.ply_text(p.coalesce(1), f"{tmp_path}/cloud") == 2
    head = spark.read.text(f"{tmp_path}/cloud/header", wholetext=True).first()[0].strip()
    body = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/cloud/body").collect())
    (tmp_path / "c.ply").write_text(f"{head}\n{body}\n")
    assert sorted(tuple(r)[1:] for r in formats.ply_points(spark, f"{tmp_path}/c.ply").collect()) == [(0.5, 1.0, 2.0), (3.0, 4.0, 5.0)]
    assert tuple(formats.inspected(spark, f"{tmp_path}/c.ply", "ply").first()) == (2, 0)


def test_aliases(spark):
    images = spark.createDataFrame([(1, "/a/One.tif"), (2, "/b/two.tif"), (3, "/c/two.png")], "idx long, path string")
    tokens = spark.createDataFrame([("one",), ("TWO.tif",), ("none",)], "token string")
    assert {r["token"]: r["idx"] for r in formats.resolved_aliases(tokens, images).collect()} == {"one": 1, "TWO.tif": 2, "none": None}
    with pytest.raises(Exception, match="ambiguous"):
        formats.resolved_aliases(spark.createDataFrame([("two",)], "token string"), images).collect()


def test_documents(spark):
    assert formats.merged_json({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}
    found, register = formats.registry()
    register("median-filter")(len)
    assert found["median-filter"] is len
    with pytest.raises(ValueError):
        register("median-filter")
    bad = spark.createDataFrame([('{"shots": [{"id": "a", "time": 1.0, "latitude": 95.0, "longitude": 0.0, "radius": 1.0}]}',)], "text string")
    assert formats.laser_shots(bad).first()["errors"] == ["latitude"]


def test_disparity_wins_by_least_cost(spark):
    left = spark.createDataFrame([(0, c, float(c * c)) for c in range(8)], "r long, c long, v double")
    right = left.select("r", (F.col("c") - 2).alias("c"), "v")
    best = dense.winner(dense.cost_volume(left, right, 4))
    assert {r["d"] for r in best.where("c >= 4").collect()} == {2}


def test_utm_on_the_central_meridian(spark):
    from fieldmesh.functions import scalars

    e, n = scalars.utm(F.lit(45.0), F.lit(9.0), 32)
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert r["e"] == pytest.approx(500000) and r["n"] == pytest.approx(4984944.378 * 0.9996, abs=0.01)


def test_mesh_distance(spark):
    from fieldmesh.operators import triangles

    vertex = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0)], "vid long, x double, y double, z double")
    face = spark.createDataFrame([(0, 0, 1, 2)], "fid long, v0 long, v1 long, v2 long")
    p = spark.createDataFrame([(1, 0.5, 0.5, 3.0), (2, -3.0, 0.0, 4.0), (3, 2.0, 2.0, 0.0)], "id long, x double, y double, z double")
    assert {r["id"]: round(r["d"], 6) for r in triangles.nearest_triangles(p, triangles.corners(vertex, face)).collect()} == {1: 3.0, 2: 5.0, 3: round(2**0.5, 6)}


def test_control_fit_drops_outliers(spark):
    from fieldmesh.operators import solvers

    rows = [(i, float(i % 5), float(i // 5), float(i % 3), i % 5 + 1.0 + (50 if i == 7 else 0), float(i // 5), float(i % 3)) for i in range(25)]
    fit, scored = solvers.control_fit(spark.createDataFrame(rows, "id long, x double, y double, z double, u double, v double, w double"), 6.0)
    assert fit["translation"] == pytest.approx([1, 0, 0], abs=1e-6)
    assert [r["id"] for r in scored.where("not used").collect()] == [7]


def test_order_statistics_without_keys_are_those_of_the_sorted_values(spark):
    import random

    from fieldmesh.functions import order_stats

    rng = random.Random(4)
    for n in (1, 2, 7, 400):
        v = [rng.choice([0.0, -0.5, 1e-300, -1e-300, 1e300, float("inf"), -float("inf"), rng.gauss(0, 1), rng.gauss(900, 1), -rng.gauss(900, 1)]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in [*v, None, float("nan")]], "v double")
        picks = {f"q{i}": order_stats.ceil_index(i / 10) for i in range(1, 10)}
        got = order_stats.order_statistics(df, [], "v", picks).first()
        one = order_stats.order_statistics(df.selectExpr("v", "1 AS k"), ["k"], "v", picks).first()
        assert got["n"] == n and all(got[q] == one[q] and got[q] in v for q in picks)
        assert got["q5"] == sorted(v)[-(-(n - 1) // 2)]
        b = [r[0] for r in spark.createDataFrame([(x,) for x in sorted(v)], "v double").coalesce(1).select(order_stats.bucket(F.col("v"))).collect()]
        assert b == sorted(b)
    empty = order_stats.order_statistics(spark.createDataFrame([], "v double"), [], "v", picks).first()
    assert empty["n"] is None and empty["q5"] is None
