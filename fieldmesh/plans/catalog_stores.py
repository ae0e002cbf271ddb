"""Registered queries over stores, manifests and journals (each written from the driver's tables and read again), gates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmesh.operators import gates, twoview
from fieldmesh.plans.catalog import query, rounded
from fieldmesh.plans.catalog_files import _mesh_lines, _one_file, documents, place
from fieldmesh.plans.standins import table
from fieldmesh.sources import readers, stores, writers

# matches and features ---------------------------------------------------------------------------------------------

PAIRS = "p AS (SELECT 's' || a AS a, 'p' || b AS b, CASE WHEN created <= 3 THEN 'coarse' ELSE 'full' END AS config, sum(inliers)::BIGINT AS first, sum(total)::BIGINT AS second FROM variants GROUP BY 1, 2, 3)"


def _pairs(spark, d) -> DataFrame:
    config = F.when(F.col("created") <= 3, "coarse").otherwise("full").alias("config")
    named = table(spark, d, "variants").select(F.concat(F.lit("s"), "a").alias("a"), F.concat(F.lit("p"), "b").alias("b"), config, "inliers", "total")
    return named.groupBy("a", "b", "config").agg(F.sum("inliers").alias("first"), F.sum("total").alias("second")).withColumn("algorithm", F.lit("sift"))


@query("s02_shard_scan", f"WITH {PAIRS} SELECT a AS owner, b AS peer, config, first, second FROM p UNION ALL SELECT b, a, config, second, first FROM p")
def shard_scan(spark, d):
    path = place(spark, "matches")
    stores.write_pairs(_pairs(spark, d), path, [("first", "second")])
    return stores.blocks(spark, path).select("owner", "peer", "config", "first", "second")


@query(
    "k02_batch_pairs",
    f"""WITH {PAIRS}, q AS (SELECT a, b, config, CASE WHEN config = 'full' AND first > 30 THEN first + 1000 ELSE first END AS first, second FROM p), m AS (SELECT a AS owner, config, first, second FROM q UNION ALL SELECT b, config, second, first FROM q)
    SELECT owner, config, count(*) AS peers, sum(first)::BIGINT AS first, sum(second)::BIGINT AS second FROM m GROUP BY owner, config""",
)
def batch_pairs(spark, d):
    path = place(spark, "matches")
    p = _pairs(spark, d)
    stores.write_pairs(p, path, [("first", "second")])
    stores.write_pairs(p.where("config = 'full' AND first > 30").withColumn("first", F.col("first") + 1000), path, [("first", "second")])
    return stores.blocks(spark, path).groupBy("owner", "config").agg(F.count("*").alias("peers"), F.sum("first").alias("first"), F.sum("second").alias("second"))


@query("s06_feature_points", "SELECT label::BIGINT AS image, count(*) AS features, max(vec_id) AS last, min(len(embedding))::BIGINT AS dims FROM embeddings GROUP BY label")
def feature_points(spark, d):
    path = place(spark, "features")
    table(spark, d, "vectors").select(F.col("label").alias("image"), F.col("id").alias("feature"), F.col("v").alias("descriptor")).write.partitionBy("image").parquet(path)
    found = spark.read.schema("feature long, descriptor array<float>, image long").parquet(path)
    return found.groupBy("image").agg(F.count("*").alias("features"), F.max("feature").alias("last"), F.min(F.size("descriptor")).cast("long").alias("dims"))


@query(
    "s07_feature_cache",
    """WITH w AS (SELECT s_suppkey AS image, 'v' || CASE WHEN s_acctbal > 5000 THEN s_nationkey ELSE 0 END AS signature FROM supplier), h AS (SELECT s_suppkey AS image, 'v' || s_nationkey AS cached, s_name AS payload FROM supplier WHERE s_acctbal > 1000)
    SELECT image, CASE WHEN cached = signature THEN payload END AS payload, coalesce(cached = signature, false) AS hit, CASE WHEN cached IS NULL THEN 'absent' WHEN cached <> signature THEN 'signature' END AS reason FROM w LEFT JOIN h USING (image)""",
)
def feature_cache(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    path = place(spark, "cache")
    s.where("s_acctbal > 1000").select(F.col("s_suppkey").alias("image"), F.concat(F.lit("v"), "s_nationkey").alias("signature"), F.col("s_name").alias("payload")).write.parquet(path)
    wanted = s.select(F.col("s_suppkey").alias("image"), F.concat(F.lit("v"), F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey")).otherwise(0)).alias("signature"))
    return stores.cached_features(wanted, spark.read.parquet(path))


@query("s25_image_probe", "SELECT s_suppkey AS image, 'png' AS format, s_nationkey::BIGINT + 640 AS width, s_suppkey + 480 AS height FROM supplier UNION ALL SELECT s_suppkey, 'bmp', s_suppkey + 480, s_nationkey::BIGINT + 640 FROM supplier")
def image_probe(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("image"), (F.col("s_nationkey") + 640).cast("long").alias("w"), (F.col("s_suppkey") + 480).alias("h"))
    big = lambda c: F.lpad(F.hex(c), 8, "0")
    little = lambda c: F.concat(*[F.substring(big(c), k, 2) for k in (7, 5, 3, 1)])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big("w"), big("h"), F.lit("0806000000"))
    bmp = F.concat(F.lit("424D"), F.lit("00" * 16), little("h"), little("w"), F.lit("01001800"))
    files = s.select("image", F.explode(F.array(F.unhex(png), F.unhex(bmp))).alias("content"))
    return files.select("image", stores.image_size(F.col("content")).alias("m")).select("image", "m.*")


# rasters and clouds -----------------------------------------------------------------------------------------------

GRID = "g AS (SELECT r, c, CASE WHEN count(*) >= 2 AND min(err) < 0.05 THEN max(z) END AS z, max(conf) AS conf, count(*)::DOUBLE AS n FROM samples GROUP BY r, c)"


def _raster(spark, d) -> str:
    path = place(spark, "raster")
    g = table(spark, d, "samples").groupBy("r", "c").agg(F.when((F.count("*") >= 2) & (F.min("err") < 0.05), F.max("z")).alias("z"), F.max("conf").alias("conf"), F.count("*").cast("double").alias("n"))
    stores.write_cells(g, path, ["z", "conf", "n"], size=4)
    return path


@query("s12_dem_raster", f"WITH {GRID} SELECT r, c, round(z, 4) AS z, z IS NOT NULL AS valid FROM g")
def dem_raster(spark, d):
    return rounded(stores.read_cells(spark, _raster(spark, d), ["z"]))


@query("k06_quality_bands", f"WITH {GRID} SELECT band, count(v) AS cells, round(min(v), 4) AS low, round(max(v), 4) AS high FROM (SELECT 'z' AS band, z AS v FROM g UNION ALL SELECT 'conf', conf FROM g UNION ALL SELECT 'n', n FROM g) GROUP BY band")
def quality_bands(spark, d):
    t = stores.read_cells(spark, _raster(spark, d), ["z", "conf", "n"]).unpivot(["r", "c"], ["z", "conf", "n"], "band", "v")
    return rounded(t.groupBy("band").agg(F.count("v").alias("cells"), F.min("v").alias("low"), F.max("v").alias("high")))


@query(
    "s14_sparse_quality",
    """SELECT l_orderkey::DOUBLE AS x, l_quantity AS y, l_linenumber::DOUBLE AS z, l_linenumber::BIGINT AS track_length, CASE WHEN l_linenumber <> 3 THEN l_discount * 40 END AS rms, l_quantity AS angle, l_linenumber <> 3 AS complete FROM lineitem WHERE l_linenumber <> 7""",
)
def sparse_quality(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    at = F.when(F.col("l_linenumber") != 7, F.array(F.col("l_orderkey").cast("double"), "l_quantity", F.col("l_linenumber").cast("double")))
    angle = lambda some: F.when(some, F.col("l_quantity"))
    old = F.col("l_linenumber") > 4
    record = F.struct(at.alias("point_xyz"), F.col("l_linenumber").alias("track_len"), F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 40).alias("rms_reproj_px"), angle(~old).alias("triangulation_angle_deg"), angle(old).alias("min_tri_angle_deg"))
    return stores.sparse_quality(spark, documents(li, F.floor(F.col("l_orderkey") / 2000), record, "points", "quality"))


@query(
    "s23_plane_samples",
    """WITH v AS (SELECT x, y, z, x - 25 AS a, z - 14 AS b FROM points WHERE x <> 25 OR z <> 14) SELECT round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(a / sqrt(a * a + b * b), 4) AS nx, 0::DOUBLE AS ny, round(b / sqrt(a * a + b * b), 4) AS nz FROM v""",
)
def plane_samples(spark, d):
    p = table(spark, d, "points").select(F.col("id").alias("at"), F.concat_ws(" ", F.col("x") - 25, F.lit("0.0"), F.col("z") - 14, "x", "y", "z").alias("value"))
    head = ["ply", "format ascii 1.0", f"element vertex {p.count()}", *[f"property double {a}" for a in ("nx", "ny", "nz", "x", "y", "z")], "end_header"]
    top = spark.createDataFrame([(k - 100, x) for k, x in enumerate(head)], "at long, value string")
    return rounded(stores.plane_samples(spark, _one_file(top.union(p), "plane")))


@query("k05_ply_validation", "SELECT 'whole' AS file, count(*) AS promised, count(*) AS found, true AS valid FROM points UNION ALL SELECT 'cut', count(*), count(*) FILTER (WHERE x < 25), false FROM points")
def ply_validation(spark, d):
    p = table(spark, d, "points")
    whole, cut = place(spark, "ply"), place(spark, "ply")
    writers.ply_text(p, whole)
    writers.ply_text(p, cut)
    writers.ply_text(p.where("x < 25"), f"{cut}/again")
    a = writers.validated_ply(spark, f"{whole}/header", f"{whole}/body").select(F.lit("whole").alias("file"), "*")
    return a.union(writers.validated_ply(spark, f"{cut}/header", f"{cut}/again/body").select(F.lit("cut").alias("file"), "*"))


@query("k08_mesh_save", "WITH n AS (SELECT n_nationkey::BIGINT AS k, max(n_nationkey) OVER () AS last FROM nation) SELECT k AS fid, k AS v0, k + 1 AS v1, k + 2 AS v2 FROM n WHERE k <= last - 2")
def mesh_save(spark, d):
    vertex, face = readers.obj_mesh(spark, _one_file(_mesh_lines(spark, d), "mesh"))
    path = place(spark, "saved")
    writers.obj_text(vertex, face, path)
    return readers.obj_mesh(spark, path)[1]


# results, manifests, projects, journals ---------------------------------------------------------------------------


@query("s20_marker_json", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'control_point' WHEN 'F' THEN 'check_point' ELSE 'gcp' END AS role, count(*) AS projections, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'role' WHEN max(l_linenumber) > 6 THEN 'state' END AS error FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus")
def marker_json(spark, d):
    state = F.when(F.col("l_linenumber") > 6, "lost").otherwise("manual_pinned")
    seen = F.struct(F.col("l_suppkey").cast("string").alias("image_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), state.alias("state"))
    p = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(seen).alias("projections"))
    role = F.when(F.col("o_orderstatus") == "O", "control_point").when(F.col("o_orderstatus") == "F", "check_point").otherwise("gcp")
    m = spark.read.parquet(f"{d}/orders.parquet").join(p, "o_orderkey").select(F.col("o_orderkey").cast("string").alias("id"), role.alias("role"), F.lit(True).alias("enabled"), "projections")
    path = place(spark, "markers")
    stores.encoded_markers(m).withColumnRenamed("json", "value").write.text(path)
    back = stores.decoded_markers(spark.read.text(path).withColumnRenamed("value", "json"))
    return back.select(F.col("id").cast("long").alias("id"), "role", F.size("projections").cast("long").alias("projections"), "error")


@query(
    "s24_terrain_manifest",
    "SELECT 'p' || p_partkey AS product_id, p_brand AS product_type, CASE WHEN p_size < 20 THEN 'dem/' || p_partkey WHEN p_size < 40 THEN 'dom/' || p_partkey ELSE 'src/' || p_partkey END AS primary_path, p_size::DOUBLE AS grid_resolution FROM part",
)
def terrain_manifest(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    where = lambda kind, test: F.when(F.expr(test), F.concat(F.lit(f"{kind}/"), "p_partkey"))
    record = F.struct(F.concat(F.lit("p"), "p_partkey").alias("product_id"), F.col("p_brand").alias("product_type"), where("dem", "p_size < 20").alias("dem_path"), where("dom", "p_size < 40").alias("dom_path"), where("src", "true").alias("source_path"), F.col("p_size").alias("grid_resolution"))
    by = p.groupBy(F.floor(F.col("p_partkey") / 2000).alias("k")).agg(F.collect_list(record).alias("products"))
    path = place(spark, "terrain")
    by.select(F.to_json(F.struct(F.lit("terrain.products").alias("schema"), "products")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return stores.terrain_products(spark, path, "terrain.products")


@query("s26_project_chunks", "SELECT r_name AS chunk, r_name = 'ASIA' AS active, 'nations' AS tables FROM region")
def project_chunks(spark, d):
    return stores.project_chunks(spark, _project(spark, d)).select("chunk", "active", F.array_join("tables", ",").alias("tables"))


@query("s27_project_session", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def project_session(spark, d):
    return stores.open_session(spark, _project(spark, d))["nations"]


def _project(spark, d) -> str:
    """A project with a chunk for each region (there are five)."""
    n, path = spark.read.parquet(f"{d}/nation.parquet"), place(spark, "project")
    regions = spark.read.parquet(f"{d}/region.parquet").orderBy("r_regionkey").collect()
    stores.save_project({r["r_name"]: {"nations": n.where(F.col("n_regionkey") == r["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))} for r in regions}, path, "ASIA")
    return path


@query("k10_result_tables", "SELECT 'points' AS name, count(*) AS rows, true AS intact FROM part UNION ALL SELECT 'cameras', count(*) FILTER (WHERE s_acctbal > 3000), count(*) FILTER (WHERE s_acctbal > 3000) = count(*) FROM supplier")
def result_tables(spark, d):
    path = place(spark, "result")
    stores.write_result({"points": table(spark, d, "points"), "cameras": table(spark, d, "images")}, path)
    table(spark, d, "images").where("x > 3000").write.mode("overwrite").parquet(f"{path}/cameras")  # what was promised is gone
    return stores.checked_result(spark, path)


@query("k14_atomic_manifest", "SELECT max(n_name) AS name, 1::BIGINT AS files FROM nation")
def atomic_manifest(spark, d):
    path = place(spark, "manifest")
    for last in spark.read.parquet(f"{d}/nation.parquet").agg(F.min("n_name"), F.max("n_name")).first():
        stores.save_atomic(spark, f"{path}/frames.json", f'{{"name": "{last}"}}')
    found = spark.read.schema("name string").json(f"{path}/frames.json")
    return found.join(spark.read.format("binaryFile").load(path).agg(F.count("*").alias("files")), F.lit(True))  # a row each


SNAPSHOT = "SELECT event_type AS stage, sha256('{\"events\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || '}') AS fingerprint FROM events"


@query("k16_stage_fingerprints", f"WITH b AS ({SNAPSHOT} GROUP BY event_type), c AS ({SNAPSHOT} WHERE event_type > 'c' AND (event_type <> 'view' OR value < 50) GROUP BY event_type) SELECT coalesce(b.stage, c.stage) AS stage, b.fingerprint, CASE WHEN c.stage IS NULL THEN 'missing' WHEN b.fingerprint = c.fingerprint THEN 'same' ELSE 'differs' END AS result FROM b FULL JOIN c ON b.stage = c.stage")
def stage_fingerprints(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    taken = lambda df: stores.stage_fingerprints(df.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users")))
    base = taken(e)
    return stores.compared_stages(base, taken(e.where("event_type > 'c' AND (event_type <> 'view' OR value < 50)"))).join(base, "stage", "left")


@query("k17_task_journal", "SELECT 'r,' || o_orderkey AS run, 1 + o_custkey AS attempt, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' ELSE 'running' END AS state, o_orderpriority || chr(9) || '100%' AS blocked_reason, CASE WHEN o_orderstatus = 'O' THEN 'a,b|c%2C' ELSE '' END AS needs FROM orders")
def task_journal(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running")
    needs = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("a,b"), F.lit("c%2C")))
    runs = o.select(F.concat(F.lit("r,"), "o_orderkey").alias("run"), (F.col("o_custkey") + 1).alias("attempt"), state.alias("state"), F.concat("o_orderpriority", F.lit("\t100%")).alias("blocked_reason"), needs.alias("dependencies"))
    path = place(spark, "journal")
    stores.write_journal(runs, path, "task journal 1")
    return stores.read_journal(spark, path, "task journal 1").select("run", "attempt", "state", "blocked_reason", F.array_join("dependencies", "|").alias("needs"))


# gates and reports ------------------------------------------------------------------------------------------------


@query(
    "f21_learned_depths",
    """WITH p AS (SELECT l_linenumber AS n, CASE WHEN l_linenumber = 5 THEN 0 ELSE l_extendedprice / 1000 * (1 + l_discount - 0.0313) END AS depth, l_discount * 4 AS conf, CASE WHEN l_quantity = 13 THEN NULL ELSE l_extendedprice / 1000 * (1 + (l_linenumber - 4) / 100.0) END AS cand, l_tax * 12 AS cc, l_extendedprice / 1000 / (1 + (l_discount - 0.0513) / 2) AS want, l_tax / 5 AS spread FROM lineitem),
    e AS (SELECT *, abs(cand - want) / want AS off, abs(depth - want) / want AS was FROM p),
    o AS (SELECT *, CASE WHEN cand IS NULL THEN 'none' WHEN cc < 0.5 THEN 'confidence' WHEN n < 3 OR spread > 0.015 THEN 'geometry' WHEN off > 0.03 THEN 'difference' WHEN depth <= 0 THEN 'filled' WHEN off < was AND cc >= conf + 0.1 THEN 'replaced' ELSE 'kept' END AS outcome FROM e)
    SELECT outcome, count(*) AS pixels, round(sum(CASE WHEN outcome IN ('filled', 'replaced') THEN cand ELSE depth END), 2) AS depth, round(max(CASE WHEN outcome IN ('filled', 'replaced') THEN least(cc, 0.5 + 0.5 * (1 - spread / 0.015)) ELSE conf END), 4) AS confidence FROM o GROUP BY outcome""",
)
def learned_depths(spark, d):
    price = F.col("l_extendedprice") / 1000
    pixels = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.when(F.col("l_linenumber") == 5, 0.0).otherwise(price * (1 + F.col("l_discount") - 0.0313)).alias("depth"), (F.col("l_discount") * 4).alias("confidence"),
        F.when(F.col("l_quantity") != 13, price * (1 + (F.col("l_linenumber") - 4) / 100.0)).alias("candidate"), (F.col("l_tax") * 12).alias("candidate_confidence"),
        F.col("l_linenumber").alias("support"), ((1 + (F.col("l_discount") - 0.0513) / 2) / price).alias("inverse_mean"), (F.col("l_tax") / 5).alias("inverse_spread"),
    )
    return gates.learned_depths(pixels).groupBy("outcome").agg(F.count("*").alias("pixels"), F.round(F.sum("depth"), 2).alias("depth"), F.round(F.max("confidence"), 4).alias("confidence"))


_CAUSES = ["no_observation", "insufficient_source", "depth_spread", "surface_weight", "support_gate", "extraction_or_postprocess", "unclassified"]
EDGES = f"""b AS (SELECT l_quantity - 25.37 AS x, l_discount * 100 - 4.41 AS y, (l_tax * 100 - 4.2) * 5 AS z, l_linenumber * 0.25 AS length, {_CAUSES}[l_linenumber] AS cause, CAST(round(l_tax * 100) AS INT) AS k, l_suppkey AS s FROM lineitem),
    t AS (SELECT *, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS turn, z / sqrt(x * x + y * y + z * z) AS up FROM b),
    boundary AS (SELECT *, (CASE WHEN up < -0.35 THEN 0 WHEN up > 0.35 THEN 2 ELSE 1 END) * 12 + CAST(floor(turn / (2 * pi()) * 12) AS BIGINT) AS sector FROM t)"""


def _boundary(spark, d) -> DataFrame:
    k = F.round(F.col("l_tax") * 100).cast("int")
    e = spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_quantity") - 25.37).alias("x"), (F.col("l_discount") * 100 - 4.41).alias("y"), ((F.col("l_tax") * 100 - 4.2) * 5).alias("z"), (F.col("l_linenumber") * 0.25).alias("length"),
        F.element_at(F.array(*[F.lit(c) for c in _CAUSES]), F.col("l_linenumber")).alias("cause"), F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")).alias("sources"),
    )
    return gates.located(e.withColumn("nx", F.lit(0.0)).withColumn("ny", F.lit(0.0)).withColumn("nz", F.when(F.col("length") > 0.5, 2.0).otherwise(0.0)), (0.0, 0.0, 0.0))


_SEVERITY = "CASE cause " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in gates.SEVERITY.items()) + " END"
_RANK = "CASE cause " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(gates.SEVERITY)) + " END"


@query(
    "a28_gap_sectors",
    f"""WITH {EDGES}, c AS (SELECT sector, cause, count(*) AS n FROM boundary GROUP BY 1, 2), w AS (SELECT sector, cause FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY n DESC, {_SEVERITY} DESC, {_RANK}) AS i FROM c) WHERE i = 1)
    SELECT b.sector, count(*) AS edges, sum(b.length)::DOUBLE AS length, sum({_SEVERITY.replace("CASE cause", "CASE b.cause")})::DOUBLE AS severity, count(*) FILTER (WHERE k = 0) AS sources_0, count(*) FILTER (WHERE k = 1) AS sources_1, count(*) FILTER (WHERE k = 2) AS sources_2, count(*) FILTER (WHERE k >= 3) AS sources_3, any_value(w.cause) AS cause, CASE WHEN max(b.length) > 0.5 THEN 1::DOUBLE END AS nz
    FROM boundary b JOIN w ON b.sector = w.sector GROUP BY b.sector""",
)
def gap_sectors(spark, d):
    return gates.boundary_sectors(_boundary(spark, d)).drop("nx", "ny")


@query(
    "a28_source_coverage",
    f"""WITH {EDGES}, s AS (SELECT sector, k, unnest(range(1, k + 1)) AS source FROM boundary), c AS (SELECT source, sector, count(*) AS n FROM s GROUP BY 1, 2), m AS (SELECT source, sector, row_number() OVER (PARTITION BY source ORDER BY n DESC, sector) AS i FROM c)
    SELECT s.source::INT AS source, count(*) AS edges, count(*) FILTER (WHERE k = 1) AS alone, count(*) FILTER (WHERE k > 1) AS shared, any_value(m.sector) AS strongest FROM s JOIN m ON s.source = m.source AND m.i = 1 GROUP BY s.source""",
)
def source_coverage(spark, d):
    return gates.source_coverage(_boundary(spark, d))


@query(
    "a28_gap_report",
    f"""WITH {EDGES}, r AS (SELECT count(*) AS edges, 0::BIGINT AS unknown, count(*) FILTER (WHERE cause IN ('support_gate', 'absolute_tsdf', 'depth_spread', 'surface_weight')) AS rematch, count(*) FILTER (WHERE cause IN ('no_observation', 'insufficient_source')) AS capture, count(*) FILTER (WHERE cause = 'extraction_or_postprocess') AS backend FROM boundary)
    SELECT *, CASE WHEN capture > rematch AND capture > backend THEN 'additional_capture_required' WHEN backend > capture AND backend > rematch THEN 'mesh_backend_diagnosis' ELSE 'existing_images_local_rematch' END AS action FROM r""",
)
def gap_report(spark, d):
    return gates.gap_report(_boundary(spark, d))


@query(
    "n09_solver_input",
    """WITH o AS (SELECT track, image, min(feature) AS feature FROM obs JOIN images ON image = idx WHERE x > 2000 GROUP BY 1, 2) SELECT track, count(*) AS views, string_agg(image || ':' || feature, ' ' ORDER BY image) AS observations FROM o GROUP BY track HAVING count(*) >= 2""",
)
def solver_input(spark, d):
    cameras = table(spark, d, "images").where("x > 2000").select(F.col("idx").alias("image"))
    tracks, _ = gates.solver_input(cameras, table(spark, d, "obs"))
    return tracks.select("track", "views", F.array_join(F.transform("observations", lambda o: F.concat_ws(":", o["image"], o["feature"])), " ").alias("observations"))


@query("n09_solver_status", "WITH c AS (SELECT idx FROM images WHERE x > 2000), o AS (SELECT DISTINCT track, image FROM obs JOIN c ON image = idx), t AS (SELECT track, count(*) AS k FROM o GROUP BY 1 HAVING count(*) >= 2) SELECT (SELECT count(*) FROM c) AS cameras, count(*) AS tracks, sum(k)::BIGINT AS observations, 'ok' AS status FROM t")
def solver_status(spark, d):
    cameras = table(spark, d, "images").where("x > 2000").select(F.col("idx").alias("image"))
    return gates.solver_input(cameras, table(spark, d, "obs"))[1]


# two views --------------------------------------------------------------------------------------------------------


@query("f13_homographies", "SELECT l_suppkey AS pair, count(*) AS valid, count(*) FILTER (WHERE l_returnflag <> 'R') AS inliers, count(*) FILTER (WHERE l_returnflag <> 'R') >= 390 AS passed FROM lineitem GROUP BY l_suppkey")
def homographies(spark, d):
    """Matches that a homography moves, but those with flag R, which are far off."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    xa, ya = F.col("l_quantity") * 20, F.col("l_extendedprice") % 997
    low = 1 + 0.0001 * xa + 0.0002 * ya
    off = F.when(F.col("l_returnflag") == "R", 200 + F.col("l_partkey") % 389).otherwise(0)
    m = li.select(F.col("l_suppkey").alias("pair"), xa.alias("xa"), ya.alias("ya"), ((1.1 * xa + 0.1 * ya + 30) / low + off).alias("xb"), ((0.9 * ya - 0.05 * xa + 12) / low + off).alias("yb"))
    return twoview.gated(twoview.verified(m, ["pair"], "homography"), ["pair"], 390)
