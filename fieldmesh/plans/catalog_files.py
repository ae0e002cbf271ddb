"""Registered queries over files: each writes a document of the format from the driver's tables, and reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmesh.operators import graph, grid, pairs, solvers
from fieldmesh.plans.catalog import query, rounded
from fieldmesh.plans.standins import table
from fieldmesh.sources import formats, readers, writers


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    return graph.until_exit(f"{graph._folder(spark)}/{name}-{uuid.uuid4().hex}")


def lines(df: DataFrame, value, name: str) -> str:
    """A text file of a line for each row, in any order; its path."""
    path = place(df.sparkSession, name)
    df.select(value.alias("value")).write.text(path)
    return path


def documents(df: DataFrame, bucket, record, field: str, name: str) -> str:
    """JSON documents, one file each, of the records of a bucket under one field; buckets are bounded. Their path."""
    path = place(df.sparkSession, name)
    grouped = df.groupBy(bucket.alias("k")).agg(F.collect_list(record).alias(field))
    grouped.select(F.to_json(F.struct(field)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("s01_image_list", "SELECT s_name AS image, 'cam' || s_nationkey AS camera FROM supplier")
def image_list(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    comment = spark.createDataFrame([("# images and cameras",), ("",)], "value string")
    path = lines(s.select(F.concat_ws(" ", "s_name", F.concat(F.lit("cam"), "s_nationkey")).alias("value")).union(comment), F.col("value"), "images")
    return readers.image_list(spark, path)


CELLS = "SELECT c::DOUBLE AS x, r::DOUBLE AS y, max(z) AS z FROM samples GROUP BY r, c"


@query("s11_dem_xyz", CELLS)
def dem_xyz(spark, d):
    g = table(spark, d, "samples").groupBy("r", "c").agg(F.max("z").alias("z"))
    return readers.xyz(spark, lines(g, F.concat_ws(" ", "c", "r", "z"), "dem"))


@query("s13_sparse_xyz", "SELECT x, y, z FROM points")
def sparse_xyz(spark, d):
    p = table(spark, d, "points").select(F.concat_ws(",", "x", "y", "z", "id").alias("value"))
    junk = spark.createDataFrame([("# x, y, z",), ("",), ("1.0,2.0",)], "value string")
    return readers.xyz(spark, lines(p.union(junk), F.col("value"), "cloud"))


def _mesh_lines(spark, d) -> DataFrame:
    """OBJ lines of a strip of triangles over the nations, with their order."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    vertex = n.select(F.col("k").alias("at"), F.concat_ws(" ", F.lit("v"), "k", "n_regionkey", F.lit("0.5")).alias("value"))
    last = n.agg(F.max("k").alias("last"))
    face = n.join(F.broadcast(last), F.col("k") <= F.col("last") - 2)  # one row
    return vertex.union(face.select(F.col("k") + 1_000, F.concat(F.lit("f "), F.col("k") + 1, F.lit("/1 "), F.col("k") + 2, F.lit("/1 "), F.col("k") + 3, F.lit("/1"))))


def _one_file(rows: DataFrame, name: str) -> str:
    """A mesh file is one unit, so its lines are one partition, in order."""
    path = place(rows.sparkSession, name)
    rows.repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


@query("s10_obj_scan", "WITH n AS (SELECT n_nationkey::BIGINT AS k, n_regionkey AS g, max(n_nationkey) OVER () AS last FROM nation) SELECT k AS fid, k AS v0, k + 1 AS v1, k + 2 AS v2, g::DOUBLE AS y0 FROM n WHERE k <= last - 2")
def obj_scan(spark, d):
    vertex, face = readers.obj_mesh(spark, _one_file(_mesh_lines(spark, d), "mesh"))
    return face.join(vertex.select(F.col("vid").alias("v0"), F.col("y").alias("y0")), "v0").select("fid", "v0", "v1", "v2", "y0")


@query("s28_asset_inspection", "SELECT count(*) AS vertices, count(*) - 2 AS faces FROM nation")
def asset_inspection(spark, d):
    return formats.inspected(spark, _one_file(_mesh_lines(spark, d), "mesh"), "obj")


@query("s09_ply_scan", "SELECT n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y, 0.25::DOUBLE AS z FROM nation")
def ply_scan(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    head = ["ply", "format ascii 1.0", f"element vertex {n.count()}", *[f"property double {a}" for a in "xyz"], "element face 0", "end_header"]
    top = spark.createDataFrame([(k - 100, x) for k, x in enumerate(head)], "at long, value string")
    body = n.select(F.col("n_nationkey").cast("long").alias("at"), F.concat_ws(" ", "n_nationkey", "n_regionkey", F.lit("0.25")).alias("value"))
    return formats.ply_points(spark, _one_file(top.union(body), "ply")).select("x", "y", "z")


@query("k03_sparse_ply", "SELECT x, y, z FROM points")
def sparse_ply(spark, d):
    path = place(spark, "ply")
    writers.ply_text(table(spark, d, "points"), path)
    return readers.xyz(spark, f"{path}/body")


@query("k04_dense_ply", "WITH v AS (SELECT DISTINCT floor(x / 4) AS i, floor(y / 4) AS j, floor(z / 4) AS k FROM points) SELECT count(*) AS points, count(*) AS promised FROM v")
def dense_ply(spark, d):
    path = place(spark, "ply")
    writers.ply_text(grid.voxels(table(spark, d, "points"), 4.0), path)
    promised = spark.read.text(f"{path}/header").select(F.max(F.regexp_extract("value", r"element vertex (\d+)", 1).try_cast("long")).alias("promised"))
    return readers.xyz(spark, f"{path}/body").agg(F.count("*").alias("points")).join(promised, F.lit(True))  # a row each


@query("k01_write_if_changed", "SELECT count(DISTINCT a) AS first, 0::BIGINT AS again, count(DISTINCT a) FILTER (WHERE a > 5) AS changed FROM variants")
def write_if_changed(spark, d):
    shards = table(spark, d, "variants").groupBy("a").agg(F.count("*").alias("blocks"), F.sum("inliers").alias("inliers"))
    path = place(spark, "shards")
    first, again = (writers.write_if_changed(shards, path, ["a"]) for _ in range(2))
    changed = writers.write_if_changed(shards.withColumn("inliers", F.when(F.col("a") > 5, F.col("inliers") + 1).otherwise(F.col("inliers"))), path, ["a"])
    return spark.createDataFrame([(first, again, changed)], "first long, again long, changed long")


@query("s15_tie_points", "SELECT track, image, feature FROM obs")
def tie_points(spark, d):
    o = table(spark, d, "obs").groupBy("track").agg(F.collect_list(F.struct("image", "feature")).alias("observations"))
    record = F.struct(F.col("track").alias("id"), "observations")
    return readers.tie_points(spark, documents(o, F.floor(F.col("track") / 4000), record, "tracks", "ties"))


@query("s17_manifest", "SELECT 'f' || frame AS name, 'completed' AS status, kind AS config FROM frames WHERE kind = 'F'")
def manifest(spark, d):
    f = table(spark, d, "frames")
    record = F.struct(F.concat(F.lit("f"), "frame").alias("name"), F.when(F.col("kind") == "F", "completed").otherwise("failed").alias("status"), F.col("kind").alias("config"))
    return readers.manifest(spark, documents(f, F.floor(F.col("frame") / 8000), record, "frames", "manifest"))


@query("p14_pair_key", r"WITH p AS (SELECT s_name || '|' || s_nationkey AS a, n_name || '\' AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey), e AS (SELECT replace(replace(a, '\', '\\'), '|', '\|') AS a, replace(replace(b, '\', '\\'), '|', '\|') AS b FROM p) SELECT least(a, b) || '|' || greatest(a, b) AS key FROM e")
def pair_key(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    p = spark.read.parquet(f"{d}/supplier.parquet").join(n, "s_nationkey").select(F.concat_ws("|", "s_name", "s_nationkey").alias("a"), F.concat(F.col("n_name"), F.lit("\\")).alias("b"))
    return p.select(pairs.pair_key(F.col("a"), F.col("b")).alias("key"))


@query(
    "w17_height_holes",
    """WITH g AS (SELECT r, c, max(z) AS z FROM samples GROUP BY r, c), v AS (SELECT * FROM g WHERE (r + c) % 3 <> 0), s AS (SELECT r + i AS r, c + j AS c, z, sqrt(i * i + j * j) AS d FROM v, range(-1, 2) x(i), range(-1, 2) y(j) WHERE i <> 0 OR j <> 0), f AS (SELECT r, c, sum(z / d) / sum(1 / d) AS f, count(*) AS k FROM s GROUP BY r, c)
    SELECT g.r, g.c, round(CASE WHEN v.z IS NOT NULL THEN v.z WHEN k >= 1 THEN f END, 4) AS z FROM g LEFT JOIN v ON g.r = v.r AND g.c = v.c LEFT JOIN f ON g.r = f.r AND g.c = f.c""",
)
def height_holes(spark, d):
    full = table(spark, d, "samples").groupBy("r", "c").agg(F.max("z").alias("z"))
    return rounded(grid.fill_holes(full.where("(r + c) % 3 <> 0"), full, 1, 1).select("r", "c", "z"))


# customers point to others, so that components branch
TREE = "e AS (SELECT c_custkey::BIGINT AS a, (c_custkey // 3)::BIGINT AS b FROM customer WHERE c_acctbal > 2000 AND c_custkey > 0)"


@query("g01_union_find", f"WITH RECURSIVE {TREE}, up AS (SELECT a AS node, b AS top FROM e UNION ALL SELECT up.node, e.b FROM up JOIN e ON up.top = e.a), n AS (SELECT node, top FROM up UNION ALL SELECT b, b FROM e) SELECT node, min(top) AS root FROM n GROUP BY node")
def union_find(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 2000 AND c_custkey > 0")
    return graph.components(c.select(F.col("c_custkey").cast("long").alias("a"), F.floor(F.col("c_custkey") / 3).cast("long").alias("b")))


@query("g04_track_records", "WITH m AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT o, count(*) AS k FROM m GROUP BY o) SELECT m.o AS record, t.k - 1 AS edges, count(*) AS observations, round(sum(q), 2)::DOUBLE AS weight FROM m JOIN t ON m.o = t.o WHERE k >= 2 GROUP BY 1, 2")
def track_records(spark, d):
    """Matches between an order's consecutive lines become tracks; tracks are joined back with the records they came from."""
    from pyspark.sql.window import Window

    one = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    m = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).select("l_orderkey", "l_linenumber", "q", F.lag("l_linenumber").over(one).alias("before"))
    matches = m.where("before is not null").select(F.col("before").cast("long").alias("image_a"), F.col("l_orderkey").cast("long").alias("feature_a"), F.col("l_linenumber").cast("long").alias("image_b"), F.col("l_orderkey").cast("long").alias("feature_b"))
    found = graph.tracks(matches).join(m.select(F.col("l_linenumber").cast("long").alias("image"), F.col("l_orderkey").cast("long").alias("feature"), "q"), ["image", "feature"])
    return found.groupBy(F.col("feature").alias("record")).agg((F.count("*") - 1).alias("edges"), F.count("*").alias("observations"), F.round(F.sum("q"), 2).alias("weight"))


@query("n04_marker_triangulation", "SELECT s_suppkey::BIGINT AS track, round(s_nationkey + 0.5, 3)::DOUBLE AS x, round(s_acctbal / 1000, 5)::DOUBLE AS y, 12::DOUBLE AS z, 4::BIGINT AS views FROM supplier")
def marker_triangulation(spark, d):
    m = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("track"), (F.col("s_nationkey") + 0.5).alias("x"), (F.col("s_acctbal") / 1000).alias("y"), F.lit(12.0).alias("z"))
    views = F.explode(F.array(*[F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oy"), F.lit(0.0).alias("oz")) for a, b in ((0.0, 0.0), (40.0, 0.0), (0.0, 40.0), (40.0, 40.0))])).alias("o")
    rays = m.select("track", "x", "y", "z", views).select("track", "o.*", (F.col("x") - F.col("o.ox")).alias("dx"), (F.col("y") - F.col("o.oy")).alias("dy"), (F.col("z") - F.col("o.oz")).alias("dz"))
    return rounded(solvers.triangulated(rays), 5)
