"""Operators on small tables with values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from fieldmesh.functions import order_stats, scalars
from fieldmesh.operators import aggregates, dense, filters, graph, grid, joins, mesh, pairs, solvers
from fieldmesh.sources import readers, writers
from fieldmesh.streaming import tasks

SAMPLE = "r long, c long, z double, conf double, err double"


def cells(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_cell_mean_and_median(spark):
    s = spark.createDataFrame([(0, 0, 10.0, 1.0, 0.0), (0, 0, 14.0, 1.0, 0.0), (1, 1, 3.0, 1.0, 0.0)], SAMPLE)
    assert cells(grid.cell_aggregate(s, "mean"), "r", "c", "z", "n") == [(0, 0, 12.0, 2), (1, 1, 3.0, 1)]
    m = spark.createDataFrame([(0, 0, v, 1.0, 0.0) for v in (1.0, 100.0, 3.0)], SAMPLE)
    assert grid.cell_aggregate(m, "median").first()["z"] == 3.0


def test_nmad_and_p80(spark):
    s = spark.createDataFrame([(0, 0, v, 1.0, 0.0) for v in (10.0, 11.0, 12.0, 50.0)], SAMPLE)
    assert grid.cell_aggregate(s, "nmad").first()["z"] == pytest.approx(1.4826)
    p = spark.createDataFrame([(0, 0, float(v), 1.0, 0.0) for v in range(1, 6)], SAMPLE)
    assert grid.cell_aggregate(p, "p80").first()["z"] == 5.0


def test_weighted_falls_back(spark):
    s = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (0, 0, 3.0, 3.0, 0.0)], SAMPLE)
    assert grid.cell_aggregate(s, "weighted").first()["z"] == pytest.approx((1 + 9) / 4)


def test_mosaic(spark):
    tiles = spark.createDataFrame([(0, 0, t, z, 1.0, 0.0) for t, z in ((0, 1.0), (1, 5.0), (2, 9.0))], "r long, c long, tile long, z double, conf double, err double")
    want = {"first": 1.0, "last": 9.0, "mean": 5.0, "median": 5.0, "min": 1.0, "max": 9.0, "confidence": 5.0, "inverse_error": 9.0}
    assert {m: grid.mosaic(tiles, m).first()["z"] for m in want} == want


def test_difference(spark):
    a = spark.createDataFrame([(0, i, v) for i, v in enumerate((11.0, 10.0, 14.0, 12.0, -9999.0, 18.0))], "r long, c long, z double")
    b = spark.createDataFrame([(0, i, v) for i, v in enumerate((10.0, 11.0, 12.0, 13.0, -9999.0, 15.0))], "r long, c long, z double")
    r = grid.difference(a, b).first()
    assert (r["n"], r["mean"], r["median"], r["p95"]) == (5, pytest.approx(0.8), 1.0, 3.0)
    assert r["rmse"] == pytest.approx(1.7888543819998317)


def test_hole_fill_reads_the_round_before(spark):
    full = spark.createDataFrame([(0, c) for c in range(5)], "r long, c long")
    some = spark.createDataFrame([(0, 0, 1.0), (0, 4, 5.0)], "r long, c long, z double")
    one = {r["c"]: (r["z"], r["filled"]) for r in grid.fill_holes(some, full, 1, 1, 1).collect()}
    assert one[1] == (1.0, 1) and one[2] == (None, 0)
    two = {r["c"]: (r["z"], r["filled"]) for r in grid.fill_holes(some, full, 1, 1, 2).collect()}
    assert two[2] == (3.0, 2)


def test_filters_keep_unknown_and_roll_back(spark):
    s = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan")), (4, 9.0)], "id long, e double")
    out, report = filters.ordered_filters(s, [("e", filters.keeps("e", most=1.0)), ("none", F.lit(False))])
    assert cells(out, "id") == [(1,), (2,), (3,)]
    assert cells(report, "step", "removed", "undone") == [("e", 1, False), ("none", 0, True)]


def test_track_conflict_removes_all_of_the_image(spark):
    edges = [((0, 0), (1, 0)), ((0, 1), (2, 0)), ((1, 0), (2, 0))]
    m = spark.createDataFrame([(a, b, c, d) for (a, b), (c, d) in edges], "image_a long, feature_a long, image_b long, feature_b long")
    assert cells(graph.tracks(m), "image") == [(1,), (2,)]


def test_track_bridge(spark):
    m = spark.createDataFrame([(0, 0, 1, 0), (2, 0, 3, 0), (1, 0, 2, 0)], "image_a long, feature_a long, image_b long, feature_b long")
    t = graph.tracks(m)
    assert t.count() == 4 and t.select("track").distinct().count() == 1


def test_strong_core(spark):
    e = spark.createDataFrame([(0, 1, 120), (1, 2, 100), (2, 3, 80), (0, 2, 35), (0, 3, 25)], "a long, b long, n long")
    assert cells(graph.strong_core(e, 60), "a", "b") == [(0, 1), (1, 2), (2, 3)]
    split = spark.createDataFrame([(0, 1, 120), (2, 3, 100), (1, 2, 35)], "a long, b long, n long")
    assert graph.strong_core(split, 60).count() == 3


def test_spanning_forest(spark):
    e = spark.createDataFrame([(0, 1, 5), (1, 2, 4), (0, 2, 9), (3, 4, 1)], "a long, b long, n long")
    assert cells(graph.spanning_forest(e), "a", "b") == [(0, 1), (0, 2), (3, 4)]


def test_ring_band(spark):
    items = spark.range(16).select(F.col("id").alias("idx"))
    got = cells(joins.band_pairs(items, 2, 16), "i", "j")
    assert (0, 15) in got and (0, 14) in got and len(got) == 32


def test_pair_union_and_limit(spark):
    items = spark.range(5).select(F.col("id").alias("idx"))
    all_ = pairs.union_of_sources(pairs.exhaustive(items))
    assert cells(pairs.limited(all_, 3), "i", "j") == [(0, 1), (0, 2), (0, 3)]


def test_nearest_agrees_with_all_pairs(spark):
    p = spark.range(300).select("id", *[(F.pmod(F.hash("id", F.lit(k)), F.lit(1000)) / 7.0).alias(a) for k, a in enumerate("xyz")])
    q = p.where("id % 10 = 0")
    fast = cells(joins.nearest(q, p, 4, 3.0, itself=False), "a_id", "rank", "b_id")
    assert fast == cells(joins.nearest_in_blocks(q, p, 4, ("x", "y", "z"), most=7), "a_id", "rank", "b_id")


def test_order_statistics(spark):
    s = spark.createDataFrame([("a", float(v)) for v in (3, 1, 2, 2)] + [("b", None), ("a", float("nan"))], "k string, v double")
    r = order_stats.order_statistics(s, ["k"], "v", {"up": order_stats.upper_median, "c": order_stats.ceil_index(0.5), "r": order_stats.round_index(0.5)}).collect()
    assert [(x["k"], x["n"], x["up"], x["c"], x["r"]) for x in r] == [("a", 4, 2.0, 2.0, 2.0)]


def test_histogram_median_exact_half(spark):
    s = spark.createDataFrame([(0.5, 1.0), (1.5, 1.0), (2.5, 2.0)], "v double, w double")
    assert aggregates.weighted_median_bins(s, [], "v", "w", 0.0, 4.0, 4).first()["med"] == pytest.approx(2.0)


def test_mesh(spark):
    vertex, face = mesh.grid_mesh(spark, 3)
    t = mesh.topology(vertex, face).first()
    assert (t["vertices"], t["faces"], t["boundary"], t["euler"]) == (16, 18, 12, 1)
    assert mesh.clean_faces(vertex, face.union(face)).count() == 18


def test_similarity_fit(spark):
    p = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)], "x double, y double, z double")
    out = scalars.similarity(F.col("x"), F.col("y"), F.col("z"), 2.0, [0, -1, 0, 1, 0, 0, 0, 0, 1], [1, 2, 3])
    fit = solvers.similarity_fit(p.select("x", "y", "z", *[c.alias(a) for c, a in zip(out, "uvw")]))
    assert fit["scale"] == pytest.approx(2.0) and fit["translation"] == pytest.approx([1, 2, 3])


def test_readers(spark, tmp_path):
    (tmp_path / "a.lis").write_text("img1.tif cam1.tsai\n\nimg2.tif\n")
    assert cells(readers.image_list(spark, str(tmp_path / "a.lis")), "image") == [("img1.tif",), ("img2.tif",)]
    (tmp_path / "a.tsai").write_text("fu = 10.5\nC = 1 2 3\n")
    assert {r["key"]: r["values"] for r in readers.key_values(spark, str(tmp_path / "a.tsai")).collect()} == {"fu": [10.5], "C": [1.0, 2.0, 3.0]}
    (tmp_path / "m.csv").write_text('Type,Name,Longitude,Latitude\nGCP,"A,1",1.5,2.5\ncheckpoint,B,x,3\n')
    assert cells(readers.markers(spark, str(tmp_path / "m.csv")), "id", "role", "usable") == [("A,1", "control", False), ("B", "check", False)]
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    vertex, face = readers.obj_mesh(spark, str(tmp_path / "m.obj"))
    assert vertex.count() == 4 and cells(face, "v0", "v1", "v2") == [(0, 1, 2), (0, 2, 3)]
    (tmp_path / "t.json").write_text(json.dumps({"tracks": [{"id": 7, "observations": [{"image": 1, "feature": 2}, {"image": 3, "feature": 4}]}]}))
    assert cells(readers.tie_points(spark, str(tmp_path / "t.json")), "track", "image", "feature") == [(7, 1, 2), (7, 3, 4)]


def test_write_if_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    path = f"file://{tmp_path}/store"
    assert writers.write_if_changed(df, path, ["k"]) == 2
    assert writers.write_if_changed(df, path, ["k"]) == 0
    assert writers.write_if_changed(df.where("v != 'b'"), path, ["k"]) == 1


def test_task_states_and_stream(spark, tmp_path):
    rows = [(1, 1, 1, "queued"), (1, 2, 2, "running"), (1, 3, 3, "queued"), (2, 1, 4, "queued")]
    e = spark.createDataFrame(rows, "run long, t long, seq long, state string").select("run", F.timestamp_seconds("t").alias("moment"), "seq", "state")
    assert [r["legal"] for r in tasks.checked(e, tasks.transitions(spark)).orderBy("seq").collect()] == [True, True, False, True]
    assert cells(tasks.latest(e), "run", "state", "revision") == [(1, "queued", 3), (2, "queued", 1)]
    e.write.parquet(f"{tmp_path}/in")
    stream = tasks.windowed_counts(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "1 minute", "1 minute")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert cells(spark.table("counts"), "state", "n") == cells(tasks.windowed_counts(e, "1 minute"), "state", "n")


def test_all_pairs_of_task_states(spark):
    """All 100 pairs: 27 steps are legal, and staying."""
    rows = [(k, t, 2 * k + t, s) for k, (a, b) in enumerate([(a, b) for a in tasks.STATES for b in tasks.STATES]) for t, s in enumerate((a, b))]
    e = spark.createDataFrame(rows, "run long, t long, seq long, state string").select("run", F.timestamp_seconds("t").alias("moment"), "seq", "state")
    got = {(r["before"], r["state"]): r["legal"] for r in tasks.checked(e, tasks.transitions(spark)).where("before is not null").collect()}
    assert len(got) == 100 and sum(got.values()) == 27 + 10
    assert all(legal == (a == b or b in tasks.TRANSITIONS.get(a, [])) for (a, b), legal in got.items())
    assert not any(got[a, b] for a in ("succeeded", "failed", "cancelled") for b in tasks.STATES if a != b)


def test_nearest_settles_far_and_placeless_points(spark):
    """Queries that the rounds did not settle meet all points; points without a coordinate count for nothing."""
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 1e6, 0.0, 0.0), (4, None, 0.0, 0.0), (5, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    got = cells(joins.nearest(pts, pts, 2, 0.5, itself=False, rounds=4), "a_id", "b_id", "rank")
    assert got == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 2), (3, 2, 1)]
    assert cells(joins.nearest(pts, pts, 5, 0.5, itself=False, rounds=3), "a_id", "b_id", "rank") == got
    assert joins.nearest(pts, pts.limit(0), 1, 0.5).count() == 0


def test_radius_outliers_hold_lonely_points(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, 0.0, 0.5, 0.0), (4, 9.0, 9.0, 9.0), (5, 20.0, 0.0, 0.0), (6, 20.5, 0.0, 0.0)], "id long, x double, y double, z double")
    assert cells(filters.radius_outliers(pts, 1.0, 2), "id", "n") == [(4, 0), (5, 1), (6, 1)]


def test_path_costs_in_all_directions(spark):
    """Against the definition, pixel by pixel."""
    import random

    rng = random.Random(1)
    cost = {(r, c): [rng.randrange(20) / 4 for _ in range(3)] for r in range(4) for c in range(5)}
    ways = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1)]
    want = {}
    for dr, dc in ways:
        done = {}
        for r, c in sorted(cost, key=lambda p: p[0] * dr * 10 + p[1] * dc):
            x = done.get((r - dr, c - dc))
            done[r, c] = cost[r, c] if x is None else [k + min(x[i], (x[i - 1] if i else 1e9) + 0.5, (x[i + 1] if i < 2 else 1e9) + 0.5, min(x) + 2) - min(x) for i, k in enumerate(cost[r, c])]
            for i, v in enumerate(done[r, c]):
                want[r, c, i] = want.get((r, c, i), 0) + v
    df = spark.createDataFrame([(r, c, i, v) for (r, c), k in cost.items() for i, v in enumerate(k)], "r long, c long, d long, cost double")
    got = {(x["r"], x["c"], x["d"]): x["total"] for x in dense.path_costs(df, 0.5, 2.0, ways).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ambiguity_limit_follows_the_upper_quartile(spark):
    rows = [(k, 1000 + k, (k / 100) ** 2, 1.0) for k in range(1, 101)]
    forward = spark.createDataFrame(rows, "a_id long, b_id long, d1 double, d2 double")
    backward = forward.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.lit(0.0).alias("d1"), F.lit(1.0).alias("d2"))
    kept = [r["a_id"] for r in joins.unambiguous(forward, backward).collect()]
    assert sorted(kept) == list(range(1, 79))  # the element at index 75 is 0.76; 0.78 is the least limit
    few = forward.where("a_id > 60")
    assert max(r["a_id"] for r in joins.unambiguous(few, backward).collect()) == 98
