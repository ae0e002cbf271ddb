"""Stores, manifests, journals and gates: what is refused, replaced, kept, and empty."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldmesh.operators import gates
from fieldmesh.sources import stores, writers


def test_pairs_are_read_from_either_image_and_replaced_by_key(spark, tmp_path):
    at = str(tmp_path / "store")
    schema = "a string, b string, algorithm string, config string, fa long, fb long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    stores.write_pairs(make(("p", "q", "m", "c1", 1, 2), ("p", "q", "m", "c2", 3, 4), ("q", "r", "m", "c1", 5, 6)), at, [("fa", "fb")])
    assert {tuple(r) for r in stores.blocks(spark, at, "r").collect()} == {("r", "q", "m", "c1", 6, 5)}
    stores.write_pairs(make(("q", "p", "m", "c1", 9, 8)), at, [("fa", "fb")])
    assert {(r.peer, r.config, r.fa, r.fb) for r in stores.blocks(spark, at, "p").collect()} == {("q", "c1", 8, 9), ("q", "c2", 3, 4)}
    stores.write_pairs(make(("p", "q", "m", "c3", 7, 7)), at, [("fa", "fb")], keep=False)
    assert {(r.peer, r.config) for r in stores.blocks(spark, at, "p").collect()} == {("q", "c3")}
    assert stores.blocks(spark, at, "r").count() == 1 and stores.blocks(spark, at, "nobody").count() == 0


def test_a_generation_without_success_is_not_read(spark, tmp_path):
    at = tmp_path / "store"
    stores.write_pairs(spark.createDataFrame([("p", "q", "m", "c")], "a string, b string, algorithm string, config string"), str(at))
    (at / "generation-1").mkdir()
    assert stores.newest(spark, str(at)) == 0 and stores.blocks(spark, str(at)).count() == 2


def test_cells_without_a_value_are_not_valid(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5, 1.0), (0, 1, None, 2.0), (600, 2, float("nan"), None)], "r int, c int, z double, conf double")
    stores.write_cells(cells, str(tmp_path / "g"), ["z", "conf"])
    got = stores.read_cells(spark, str(tmp_path / "g"), ["z"])
    assert "conf" not in got.columns
    assert {(r.r, r.c, r.z, r.valid) for r in got.collect()} == {(0, 0, 1.5, True), (0, 1, None, False), (600, 2, None, False)}


@pytest.mark.parametrize("text", ['{"schema": "other", "products": []}', '{"schema": "s"}', '{"schema": "s", "products": [{"product_id": "a", "dem_tif": "x"}]}'])
def test_terrain_manifests_that_are_refused(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(PySparkException):
        stores.terrain_products(spark, str(tmp_path / "m.json"), "s").collect()


def test_terrain_products_by_primary_path(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema": "s", "products": [{"product_id": "b", "dom_path": "z"}, {"product_id": "a", "dem_path": "", "error_path": "y", "grid_resolution": 2}, {"product_id": "c"}]}')
    assert [(r.product_id, r.primary_path, r.grid_resolution) for r in stores.terrain_products(spark, str(tmp_path / "m.json"), "s").collect()] == [("c", "", 0.0), ("a", "y", 2.0), ("b", "z", 0.0)]


def test_journals_give_back_any_text(spark, tmp_path):
    rows = [("r\t1", 1, "queued", "50%,\n\r", ["a,b", "%09"]), ("", 2, "failed", None, None), ("é", 3, "paused", "", [])]
    runs = spark.createDataFrame(rows, "run string, attempt long, state string, blocked_reason string, dependencies array<string>")
    stores.write_journal(runs, str(tmp_path / "j"), "v1")
    got = {tuple(r) for r in stores.read_journal(spark, str(tmp_path / "j"), "v1").withColumn("dependencies", F.to_json("dependencies")).collect()}
    assert got == {("r\t1", 1, "queued", "50%,\n\r", '["a,b","%09"]'), ("", 2, "failed", "", "[]"), ("é", 3, "paused", "", "[]")}
    with pytest.raises(ValueError):
        stores.read_journal(spark, str(tmp_path / "j"), "v2")
    (tmp_path / "j" / "runs" / "more.txt").write_text("RUN\tx\tnot a number\tq\t\t\n")
    with pytest.raises(PySparkException):
        stores.read_journal(spark, str(tmp_path / "j"), "v1").collect()


def test_results_without_a_sidecar_are_none(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "r" / "points"))
    with pytest.raises(PySparkException):
        stores.checked_result(spark, str(tmp_path / "r"))
    stores.write_result({"points": spark.range(3), "none": spark.range(0)}, str(tmp_path / "r"))
    assert {tuple(r) for r in stores.checked_result(spark, str(tmp_path / "r")).collect()} == {("points", 3, True), ("none", 0, True)}


def test_sessions_refuse_unknown_chunks(spark, tmp_path):
    stores.save_project({"a": {"t": spark.range(2)}, "b": {"t": spark.range(5)}}, str(tmp_path / "p"), "b")
    assert stores.open_session(spark, str(tmp_path / "p"))["t"].count() == 5
    assert stores.open_session(spark, str(tmp_path / "p"), "a")["t"].count() == 2
    with pytest.raises(KeyError):
        stores.open_session(spark, str(tmp_path / "p"), "c")


def test_markers_with_numbers_that_are_not_finite(spark):
    m = spark.sql("SELECT 'm' AS id, 'tie_marker' AS role, true AS enabled, array(named_struct('image_id', 'i', 'x', double('nan'), 'y', 2.0D, 'state', 'predicted')) AS projections")
    row = stores.decoded_markers(stores.encoded_markers(m)).first()
    assert row.error is None and row.projections[0].x is None and row.projections[0].y == 2.0
    assert stores.decoded_markers(spark.sql("SELECT '{}' AS json")).first().error == "id"
    assert stores.decoded_markers(spark.sql("SELECT 'no json' AS json")).first().error == "id"


def test_image_size_of_other_bytes(spark):
    rows = spark.createDataFrame([(bytearray(b""),), (None,), (bytearray(b"\x89PNG"),), (bytearray(b"GIF89a\x40\x01\xf0\x00"),)], "content binary")
    assert [r.m and tuple(r.m) for r in rows.select(stores.image_size(F.col("content")).alias("m")).collect()] == [None, None, None, ("gif", 320, 240)]


def test_a_cut_ply_is_not_valid(spark, tmp_path):
    p = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "x double, y double, z double")
    writers.ply_text(p, str(tmp_path / "a"))
    assert writers.validated_ply(spark, str(tmp_path / "a/header"), str(tmp_path / "a/body")).first().valid
    writers.ply_text(p.limit(1), str(tmp_path / "b"))
    assert not writers.validated_ply(spark, str(tmp_path / "a/header"), str(tmp_path / "b/body")).first().valid


def test_learned_depths_need_geometry(spark):
    schema = "depth double, confidence double, candidate double, candidate_confidence double, support int, inverse_mean double, inverse_spread double"
    rows = {
        "none": (2.0, 0.5, None, 0.9, 5, 0.5, 0.0), "confidence": (2.0, 0.5, 2.0, 0.4, 5, 0.5, 0.0), "geometry": (2.0, 0.5, 2.0, 0.9, 2, 0.5, 0.0),
        "difference": (2.0, 0.5, 2.2, 0.9, 5, 0.5, 0.0), "filled": (0.0, 0.0, 2.0, 0.9, 5, 0.5, 0.0075), "replaced": (2.05, 0.5, 2.0, 0.9, 5, 0.5, 0.0), "kept": (2.05, 0.85, 2.0, 0.9, 5, 0.5, 0.0),
    }
    got = gates.learned_depths(spark.createDataFrame(list(rows.values()), schema)).collect()
    assert [r.outcome for r in got] == list(rows)
    assert (got[4].depth, got[4].confidence) == (2.0, 0.75) and got[6].depth == 2.05
    odd = (float("nan"), None, 2.0, 0.9, 5, 0.5, float("nan"))
    assert gates.learned_depths(spark.createDataFrame([odd], schema)).first().outcome == "geometry"


def test_gap_reports(spark):
    schema = "x double, y double, z double, length double, cause string, sources array<int>, nx double, ny double, nz double"
    rows = [(1.0, 0.1, 0.0, 2.0, "no_observation", [], 0.0, 0.0, 2.0), (1.0, 0.1, 0.0, 1.0, "support_gate", [3], 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0, "no_observation", [3, 4], 1.0, 0.0, 0.0), (0.0, -1.0, 9.0, 1.0, "none", [4, 4], 1.0, 0.0, 0.0)]
    e = gates.located(spark.createDataFrame(rows, schema), (0.0, 0.0, 0.0))
    s = {r.sector: r for r in gates.boundary_sectors(e).collect()}
    assert set(s) == {-1, 12, 33} and s[12].cause == "no_observation" and s[12].severity == 5.25 and s[12].nz == 1.0 and s[12].sources_1 == 1
    assert {tuple(r) for r in gates.source_coverage(e).collect()} == {(3, 2, 1, 1, 12), (4, 2, 1, 1, 33)}
    assert tuple(gates.gap_report(e).first()) == (4, 1, 1, 2, 0, "additional_capture_required")
    assert tuple(gates.gap_report(e.limit(0)).first()) == (0, 0, 0, 0, 0, "existing_images_local_rematch")


def test_solver_input_says_what_is_missing(spark):
    obs = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 2, 4), (2, 1, 7), (3, 9, 1)], "track long, image long, feature long")
    cams = spark.createDataFrame([(1,), (2,)], "image long")
    tracks, status = gates.solver_input(cams, obs)
    assert [(r.track, [tuple(o) for o in r.observations]) for r in tracks.collect()] == [(1, [(1, 5), (2, 4)])]
    assert status.first().status == "ok"
    assert gates.solver_input(cams.limit(1), obs)[1].first().status == "not_enough_cameras"
    assert gates.solver_input(cams, obs.where("track = 2"))[1].first().status == "no_tracks"
