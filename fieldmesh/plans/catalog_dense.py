"""More registered queries: dense matching, fusion, meshes, blocks, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmesh.functions import scalars
from fieldmesh.operators import aggregates, dense, filters, graph, grid, joins, mesh, pairs, planning
from fieldmesh.plans.catalog import DIST, FULL, SCORES, SHARED, TURNS, _balanced, _scores, query, rounded
from fieldmesh.plans.standins import table
from fieldmesh.sources import formats

PIXELS = "l AS (SELECT r, c, min(z) AS v FROM samples GROUP BY r, c), q AS (SELECT r, c, max(z) - 90 AS v FROM samples GROUP BY r, c)"
COST = f"{PIXELS}, e AS (SELECT l.r, l.c, d, abs(l.v - q.v) AS e FROM l, range(4) t(d) JOIN q ON true WHERE l.r = q.r AND q.c = l.c - d), k AS (SELECT r, c, d, avg(e) OVER (PARTITION BY r, d ORDER BY c RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS cost FROM e)"


def _costs(spark, d):
    s = table(spark, d, "samples")
    left = s.groupBy("r", "c").agg(F.min("z").alias("v"))
    right = s.groupBy("r", "c").agg((F.max("z") - 90).alias("v"))
    return dense.cost_volume(left, right, 4).withColumn("d", F.col("d").cast("long"))


@query("w15_cost_volume", f"WITH {COST} SELECT r, c, d, round(cost, 4) AS cost FROM k")
def cost_volume(spark, d):
    return rounded(_costs(spark, d))


@query("w14_least_cost", f"WITH {COST} SELECT r, c, min_by(d, (cost, d)) AS d FROM k GROUP BY r, c")
def least_cost(spark, d):
    return dense.winner(_costs(spark, d))


def _line(name: str, line: str, at: str) -> str:
    """SQL of the costs along lines, in order of place: v is the list of a pixel's costs by disparity."""
    return f"""{name} AS (SELECT {line} AS l, {at} AS p, r, c, v FROM u WHERE ({line}, {at}) IN (SELECT ({line}, min({at})) FROM u GROUP BY {line}) UNION ALL SELECT x.l, n.p, n.r, n.c, list_transform(generate_series(1, 4), lambda i: n.v[i]
    + least(x.v[i], coalesce(x.v[i - 1], 1e18) + 0.5::DOUBLE, coalesce(x.v[i + 1], 1e18) + 0.5::DOUBLE, list_min(x.v) + 2.0::DOUBLE) - list_min(x.v)) FROM {name} x JOIN (SELECT {line} AS l, {at} AS p, lag({at}) OVER (PARTITION BY {line} ORDER BY {at}) AS b, r, c, v FROM u) n ON n.l = x.l AND n.b = x.p)"""


PATHS = {(0, 1): ("r", "c"), (0, -1): ("r", "-c"), (1, 0): ("c", "r"), (-1, 0): ("c", "-r"), (1, 1): ("r - c", "r"), (1, -1): ("r + c", "r")}


@query(
    "w12_path_costs",
    f"WITH RECURSIVE {COST}, w AS (SELECT r, c, list(cost ORDER BY d) AS v, count(*) AS n FROM k GROUP BY r, c), u AS (SELECT r, c, v FROM w WHERE n = 4), "
    + ", ".join(_line(f"p{i}", *x) for i, x in enumerate(PATHS.values()))
    + ", t AS ("
    + " UNION ALL ".join(f"SELECT r, c, v FROM p{i}" for i in range(len(PATHS)))
    + ") SELECT r, c, d - 1 AS d, round(sum(v[d]), 4) AS total FROM t, generate_series(1, 4) g(d) GROUP BY r, c, d",
)
def path_costs(spark, d):
    k = _costs(spark, d)
    whole = k.groupBy("r", "c").agg(F.count("*").alias("n")).where("n = 4").select("r", "c")
    return rounded(dense.path_costs(k.join(whole, ["r", "c"], "left_semi"), 0.5, 2.0, list(PATHS)).withColumn("d", F.col("d").cast("long")))


@query("w10_left_right_check", "WITH a AS (SELECT r, c, max(tile) % 3 AS d FROM samples GROUP BY r, c), b AS (SELECT r, c, min(tile) % 3 AS d FROM samples GROUP BY r, c) SELECT a.r, a.c, a.d FROM a JOIN b ON a.r = b.r AND b.c = a.c - a.d WHERE abs(a.d - b.d) <= 1")
def left_right(spark, d):
    s = table(spark, d, "samples")
    return dense.left_right_check(s.groupBy("r", "c").agg((F.max("tile") % 3).alias("d")), s.groupBy("r", "c").agg((F.min("tile") % 3).alias("d")), 1)


@query(
    "w11_speckles",
    """WITH RECURSIVE s0 AS (SELECT r, c, count(*) % 10 AS d FROM samples GROUP BY r, c), e AS (SELECT a.r AS r, a.c AS c, b.r AS r2, b.c AS c2 FROM s0 a JOIN s0 b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND abs(a.d - b.d) <= 2),
    p AS (SELECT r, c, r AS r2, c AS c2 FROM s0 UNION SELECT p.r, p.c, e.r2, e.c2 FROM p JOIN e ON p.r2 = e.r AND p.c2 = e.c) SELECT s0.r, s0.c, s0.d FROM s0 JOIN p ON s0.r = p.r AND s0.c = p.c GROUP BY 1, 2, 3 HAVING count(*) >= 4""",
)
def speckles(spark, d):
    return dense.speckles(table(spark, d, "samples").groupBy("r", "c").agg((F.count("*") % 10).alias("d")), 2, 4)


VIEWS = "v AS (SELECT tile AS view, r, c, avg(z) AS depth, sum(conf) + 0.01 AS weight FROM samples GROUP BY 1, 2, 3)"


def _views(spark, d):
    return table(spark, d, "samples").groupBy(F.col("tile").alias("view"), "r", "c").agg(F.avg("z").alias("depth"), (F.sum("conf") + 0.01).alias("weight"))


@query("f18_consistent_views", f"WITH {VIEWS} SELECT a.view, a.r, a.c, count(*) AS support FROM v a JOIN v b ON a.r = b.r AND a.c = b.c AND a.view <> b.view WHERE abs(a.depth - b.depth) <= 0.03 * a.depth GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def consistent_views(spark, d):
    return dense.consistent_views(_views(spark, d), 0.03, 2)


@query("r01_depth_fusion", f"WITH {VIEWS} SELECT r, c, round(list_sort(list(depth))[floor(count(*) / 2)::INT + 1], 4) AS depth, count(*) AS n FROM v GROUP BY r, c")
def depth_fusion(spark, d):
    return rounded(dense.fused(_views(spark, d)))


@query("w16_consensus", f"WITH {VIEWS}, a AS (SELECT * FROM v WHERE view = 1), w AS (SELECT a.r, a.c, a.depth AS anchor, a.weight AS own, v.depth, CASE WHEN abs(v.depth - a.depth) <= 2 THEN v.weight ELSE 0 END AS weight FROM a LEFT JOIN (SELECT * FROM v WHERE view <> 1) v ON a.r = v.r AND a.c = v.c) SELECT r, c, round((sum(weight * coalesce(depth, 0)) + any_value(own) * any_value(anchor)) / (sum(weight) + any_value(own)), 4) AS depth FROM w GROUP BY r, c")
def consensus(spark, d):
    v = _views(spark, d)
    return rounded(dense.consensus(v.where("view <> 1").select("r", "c", "depth", "weight"), v.where("view = 1"), 2.0))


@query("n12_implicit_field", "SELECT floor(x / 8)::BIGINT AS vx, floor(y / 8)::BIGINT AS vy, floor(z / 8)::BIGINT AS vz, round(sum((rank + 1) * greatest(-1, least(1, (z - 14) / 5))) / sum(rank + 1), 4) AS value, round(sum(rank + 1), 4) AS weight FROM points GROUP BY 1, 2, 3")
def implicit_field(spark, d):
    p = table(spark, d, "points").select("x", "y", "z", (F.col("z") - 14).alias("distance"), (F.col("rank") + 1).alias("weight"))
    return rounded(dense.implicit_field(p, 8.0, 5.0))


@query("n16_visual_hull", "WITH w(angle, lo, hi) AS (VALUES (0.0::DOUBLE, 10.0::DOUBLE, 40.0::DOUBLE), (1.0::DOUBLE, 20.0::DOUBLE, 60.0::DOUBLE)) SELECT id FROM points, w GROUP BY id HAVING bool_and(x * cos(angle) + y * sin(angle) >= lo AND x * cos(angle) + y * sin(angle) <= hi)")
def visual_hull(spark, d):
    return dense.visual_hull(table(spark, d, "points"), spark.createDataFrame([(0.0, 10.0, 40.0), (1.0, 20.0, 60.0)], "angle double, lo double, hi double"))


@query("a19_weighted_evidence", "SELECT r, c, round(sum(conf * (1 - err)), 4) AS evidence, count(*) FILTER (WHERE conf > 0.05) AS strong FROM samples GROUP BY r, c")
def weighted_evidence(spark, d):
    return rounded(table(spark, d, "samples").groupBy("r", "c").agg(F.sum(F.col("conf") * (1 - F.col("err"))).alias("evidence"), F.count_if(F.col("conf") > 0.05).alias("strong")))


@query("a18_depth_quality", f"WITH {FULL}, s AS (SELECT g.r, g.c, g.z, h.z AS nxt FROM g LEFT JOIN g h ON h.r = g.r AND h.c = g.c + 1) SELECT count(*) AS cells, count(*) FILTER (WHERE abs(z - nxt) > 1) AS breaks, round(avg(abs(z - nxt)), 4) AS roughness FROM s")
def depth_quality(spark, d):
    g = grid.cell_aggregate(table(spark, d, "samples"), "mean").select("r", "c", "z")
    s = g.join(g.select("r", (F.col("c") - 1).alias("c"), F.col("z").alias("right")), ["r", "c"], "left")
    step = F.abs(F.col("z") - F.col("right"))
    return rounded(s.agg(F.count("*").alias("cells"), F.count_if(step > 1).alias("breaks"), F.avg(step).alias("roughness")))


@query("a25_mask_overlap", "WITH a AS (SELECT DISTINCT r, c FROM samples WHERE z > 85), b AS (SELECT DISTINCT r, c FROM samples WHERE conf > 0.079 AND z > 70) SELECT round(count(*) FILTER (WHERE a.r IS NOT NULL AND b.r IS NOT NULL) / count(*), 4) AS iou, round(count(*) FILTER (WHERE a.r IS NOT NULL AND b.r IS NOT NULL) / count(b.r), 4) AS precision FROM a FULL JOIN b ON a.r = b.r AND a.c = b.c")
def mask_overlap(spark, d):
    s = table(spark, d, "samples")
    a, b = (s.where(w).select("r", "c").distinct().withColumn(n, F.lit(1)) for w, n in (("z > 85", "a"), ("conf > 0.079 and z > 70", "b")))
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return rounded(a.join(b, ["r", "c"], "full").agg((both / F.count("*")).alias("iou"), (both / F.count("b")).alias("precision")))


@query("a26_view_failures", "SELECT tile, array_to_string(list_sort(list(DISTINCT flag)), ',') AS flags, count(*) FILTER (WHERE z > 90) AS failures FROM samples GROUP BY tile")
def view_failures(spark, d):
    return table(spark, d, "samples").groupBy("tile").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.count_if(F.col("z") > 90).alias("failures"))


@query("a27_boundary_causes", "SELECT 'rim' AS cause, 80::BIGINT AS edges")
def boundary_causes(spark, d):
    _, face = mesh.grid_mesh(spark, 20)
    rim = mesh.edges(face).where("uses = 1")
    cause = F.when((F.col("a") % 21 == 0) | (F.col("a") % 21 == 20) | (F.col("a") < 21) | (F.col("b") >= 420), "rim").otherwise("hole")
    return rim.groupBy(cause.alias("cause")).agg(F.count("*").alias("edges"))


@query("a31_rejections", "SELECT CASE WHEN conf = 0 THEN 'no_confidence' WHEN err > 0.08 THEN 'error' ELSE 'kept' END AS reason, count(*) AS n FROM samples GROUP BY 1")
def rejections(spark, d):
    s = filters.reasons(table(spark, d, "samples"), [("no_confidence", F.col("conf") != 0), ("error", F.col("err") <= 0.08)])
    return s.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("a32_scene_shape", "WITH m AS (SELECT var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy, avg(x) AS mx, avg(y) AS my FROM points), t AS (SELECT DISTINCT floor(degrees(atan2(y - my, x - mx)))::BIGINT AS t FROM points, m), g AS (SELECT coalesce(lead(t) OVER (ORDER BY t), first(t) OVER (ORDER BY t) + 360) - t AS gap FROM t) SELECT round((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + vxy ** 2), 4) AS along, round((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + vxy ** 2), 4) AS across, (SELECT max(gap) FROM g)::BIGINT AS gap FROM m")
def scene_shape(spark, d):
    return rounded(planning.scene_shape(table(spark, d, "points")))


@query("a02_dem_from_cloud", "SELECT floor(y / 5)::BIGINT AS r, floor(x / 5)::BIGINT AS c, round(avg(z), 4) AS z, count(*) AS n FROM points GROUP BY 1, 2")
def dem_from_cloud(spark, d):
    p = table(spark, d, "points").select(F.floor(F.col("y") / 5).alias("r"), F.floor(F.col("x") / 5).alias("c"), "z", F.lit(1.0).alias("conf"), F.lit(0.0).alias("err"))
    return rounded(grid.cell_aggregate(p, "mean").select("r", "c", "z", "n"))


@query("a03_dem_from_depth", "WITH p AS (SELECT (x - 25) * (z + 1) / 20 AS px, (y - 25) * (z + 1) / 20 AS py, z + 1 AS pz FROM points) SELECT floor(py / 4)::BIGINT AS r, floor(px / 4)::BIGINT AS c, round(quantile_cont(pz, 0.5), 4) AS z, count(*) AS n FROM p GROUP BY 1, 2")
def dem_from_depth(spark, d):
    x, y, z = scalars.unproject(F.col("x"), F.col("y"), F.col("z") + 1, 20.0, 20.0, 25.0, 25.0)
    p = table(spark, d, "points").select(F.floor(y / 4).alias("r"), F.floor(x / 4).alias("c"), z.alias("z"), F.lit(1.0).alias("conf"), F.lit(0.0).alias("err"))
    return rounded(grid.cell_aggregate(p, "median").select("r", "c", "z", "n"))


@query("p08_dem_sample", f"WITH {FULL}, p AS (SELECT id, x / 12 AS gc, y / 30 AS gr FROM points), s AS (SELECT p.id, g.z, (1 - abs(gr - g.r)) * (1 - abs(gc - g.c)) AS w FROM p JOIN g ON g.r IN (floor(gr), floor(gr) + 1) AND g.c IN (floor(gc), floor(gc) + 1)) SELECT id, round(sum(w * z) / sum(w), 4) AS z FROM s WHERE w > 0 GROUP BY id")
def dem_sample(spark, d):
    g = grid.cell_aggregate(table(spark, d, "samples"), "mean").select("r", "c", "z")
    p = table(spark, d, "points").select("id", (F.col("x") / 12).alias("gc"), (F.col("y") / 30).alias("gr"))
    corners = p.select("*", F.explode(F.array(*[F.struct((F.floor("gr") + a).alias("r"), (F.floor("gc") + b).alias("c")) for a in (0, 1) for b in (0, 1)])).alias("k")).select("id", "gr", "gc", "k.r", "k.c")
    w = (1 - F.abs(F.col("gr") - F.col("r"))) * (1 - F.abs(F.col("gc") - F.col("c")))
    return rounded(corners.join(g, ["r", "c"]).withColumn("w", w).where("w > 0").groupBy("id").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z")))


@query("p09_footprint", "SELECT id, round((z + 1) * sqrt(640 * 640 + 480 * 480) / (2 * 700), 4) AS radius FROM points")
def footprint(spark, d):
    corner = scalars.unproject(F.lit(320.0), F.lit(240.0), F.col("z") + 1, 700.0, 700.0, 0.0, 0.0)
    return rounded(table(spark, d, "points").select("id", F.sqrt(corner[0] * corner[0] + corner[1] * corner[1]).alias("radius")))


@query("p15_pair_key_codec", "SELECT s_suppkey AS id, least(s_name, 'a|b') AS a, greatest(s_name, 'a|b') AS b FROM supplier")
def pair_key_codec(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    a, b = formats.pair_key_parts(pairs.pair_key(F.col("s_name"), F.lit("a|b")))
    return s.select(F.col("s_suppkey").alias("id"), a.alias("a"), b.alias("b"))


@query("p22_mask_filter", "WITH m AS (SELECT r, c FROM samples GROUP BY r, c HAVING avg(z) > (SELECT avg(z) FROM samples)), k AS (SELECT id, floor(y / 10)::BIGINT AS r, floor(x / 5)::BIGINT AS c FROM points) SELECT id FROM k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.r = k.r AND m.c = k.c)")
def mask_filter(spark, d):
    s = table(spark, d, "samples")
    m = s.groupBy("r", "c").agg(F.avg("z").alias("z")).join(F.broadcast(s.agg(F.avg("z").alias("all"))), F.col("z") > F.col("all")).select("r", "c")  # one row
    k = table(spark, d, "points").select("id", F.floor(F.col("y") / 10).alias("r"), F.floor(F.col("x") / 5).alias("c"))
    return k.join(m, ["r", "c"], "left_anti").select("id")


@query("p24_track_quality", "SELECT o.track, count(DISTINCT o.image) AS images, round(avg(s.reproj), 4) AS error FROM obs o JOIN (SELECT id, avg(reproj) AS reproj FROM sparse GROUP BY id) s ON s.id = o.track GROUP BY o.track")
def track_quality(spark, d):
    s = table(spark, d, "sparse").groupBy(F.col("id").alias("track")).agg(F.avg("reproj").alias("reproj"))
    return rounded(table(spark, d, "obs").join(s, "track").groupBy("track").agg(F.countDistinct("image").alias("images"), F.avg("reproj").alias("error")))


@query("f14_stationary_tracks", "SELECT l_orderkey AS track FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND greatest(max(l_quantity) - min(l_quantity), (max(l_discount) - min(l_discount)) * 100) <= 4 * avg(l_tax * 100)")
def stationary(spark, d):
    o = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("track"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), (F.col("l_tax") * 100).alias("scale"))
    return planning.stationary_tracks(o, units=(1.0, 100.0))


@query("f19_depth_retention", "SELECT count(*) FILTER (WHERE conf > 0.04 OR (conf > 0.02 AND err < 0.03)) AS kept, count(*) AS n FROM samples")
def depth_retention(spark, d):
    return table(spark, d, "samples").agg(F.count_if((F.col("conf") > 0.04) | ((F.col("conf") > 0.02) & (F.col("err") < 0.03))).alias("kept"), F.count("*").alias("n"))


@query("f24_mesh_component_filter", "SELECT 800::BIGINT AS faces")
def mesh_component_filter(spark, d):
    _, face = mesh.grid_mesh(spark, 20)
    apart = face.limit(0).union(spark.createDataFrame([(5000, 9001, 9002, 9003)], "fid long, v0 long, v1 long, v2 long"))
    both = face.union(apart)
    small = mesh.face_components(both).where("faces >= 10")
    return small.agg(F.sum("faces").alias("faces"))


@query("f26_final_gate", "SELECT tile, avg(z) > 20 AND count(*) > 3 AND max(err) <= 0.1 AS passed FROM samples GROUP BY tile")
def final_gate(spark, d):
    s = table(spark, d, "samples").groupBy("tile").agg(F.avg("z").alias("z"), F.count("*").alias("n"), F.max("err").alias("e"))
    return filters.gate(s, [("z", F.col("z") > 20), ("n", F.col("n") > 3), ("e", F.col("e") <= 0.1)]).select("tile", "passed")


@query("j16_source_scores", f"WITH {SHARED}, b AS (SELECT a AS ref, b AS src, n AS common FROM s UNION ALL SELECT b, a, n FROM s) SELECT ref, src, common, CASE WHEN (ref + src) % 3 = 0 THEN ((ref * 7 + src) % 40)::DOUBLE END AS angle FROM b")
def source_scores(spark, d):
    o = table(spark, d, "obs")
    angles = joins.both_ways(joins.shared_tracks(o)).where("(owner + peer) % 3 = 0").select(F.col("owner").alias("ref"), F.col("peer").alias("src"), ((F.col("owner") * 7 + F.col("peer")) % 40).cast("double").alias("angle"))
    return planning.source_scores(o, angles)


@query("t03_overlap_sort", "SELECT a.idx AS i, b.idx AS j, round(1 - abs(a.x - b.x) / greatest(1e-6, 1.2 * (a.radius + b.radius)), 4) AS score FROM images a JOIN images b ON a.idx < b.idx WHERE abs(a.x - b.x) <= greatest(1e-6, 1.2 * (a.radius + b.radius)) AND abs(a.x - b.x) <= 2.5 * 1.2 * a.radius ORDER BY score DESC, i, j")
def overlap_sort(spark, d):
    return rounded(joins.overlap_pairs(table(spark, d, "images"), 1.2)).orderBy(F.desc("score"), "i", "j")


@query("t04_pair_plan", f"{SCORES}, c AS (SELECT ref AS i, src AS j, score::DOUBLE AS priority, common, 'overlap' AS source FROM q WHERE ref < src UNION ALL SELECT a.idx, b.idx, 40.0, 0, 'sequence' FROM images a JOIN images b ON b.idx > a.idx AND b.idx <= a.idx + 2) SELECT i, j, round(sum(priority), 4) AS priority, max(common) AS common, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM c GROUP BY i, j")
def pair_plan(spark, d):
    wide = _scores(spark, d).where("ref < src").select(F.col("ref").alias("i"), F.col("src").alias("j"), F.col("score").cast("double").alias("priority"), "common", F.lit("overlap").alias("source"))
    near = joins.band_pairs(table(spark, d, "images"), 2).select("i", "j", F.lit(40.0).alias("priority"), F.lit(0).cast("long").alias("common"), F.lit("sequence").alias("source"))
    out = wide.unionByName(near).groupBy("i", "j").agg(F.sum("priority").alias("priority"), F.max("common").alias("common"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return rounded(out)


@query("t06_initial_pairs", f"WITH {SHARED} SELECT a, b, n FROM s ORDER BY n DESC, a, b LIMIT 20")
def initial_pairs(spark, d):
    return joins.shared_tracks(table(spark, d, "obs")).orderBy(F.desc("n"), "a", "b").limit(20)


@query("t07_completed_frames", "SELECT frame FROM frames WHERE kind = 'F' ORDER BY frame")
def completed_frames(spark, d):
    return table(spark, d, "frames").where("kind = 'F'").select("frame").orderBy("frame")


@query("u03_code_dedupe", "SELECT a, min(variant) AS variant FROM variants GROUP BY a")
def code_dedupe(spark, d):
    return table(spark, d, "variants").groupBy("a").agg(F.min("variant").alias("variant"))


@query("g11_balanced_blocks")
def balanced_blocks(spark, d):
    return planning.balanced_blocks(table(spark, d, "chain"), 5)


@query("u08_block_overlap")
def block_overlap(spark, d):
    e = table(spark, d, "chain")
    return planning.block_overlap(planning.balanced_blocks(e, 5), e, 2).withColumn("nodes", F.array_join("nodes", ","))


@query("g15_task_admission", "SELECT o_orderkey AS task, (row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1)::INT AS depth FROM orders")
def task_admission(spark, d):
    from pyspark.sql.window import Window

    # an order waits for its customer's order of the same priority before it
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    needs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("task"), before.alias("need"))
    loop = spark.createDataFrame([(-50, -51), (-51, -50), (-52, -50)], "task long, need long")  # never admitted
    return planning.admissible(needs.select("task").union(loop.select("task")), needs.where("need is not null").union(loop))


@query("g08_spatial_network", f"WITH k AS (SELECT a.id AS x, b.id AS y FROM queries a JOIN queries b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) <= 2) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM k WHERE (x + y) % 3 <> 0")
def spatial_network(spark, d):
    q = table(spark, d, "queries")
    near = joins.nearest(q, q, 2, 4.0, itself=False)
    return near.where("(a_id + b_id) % 3 <> 0").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


@query("g05_thinned_tracks", f"WITH {TURNS} SELECT x.image AS a, y.image AS b, count(*) AS n FROM w x JOIN w y ON x.track = y.track AND x.image < y.image GROUP BY 1, 2")
def thinned_tracks(spark, d):
    return joins.shared_tracks(_balanced(spark, d))


@query("n24_descriptor_nn", "SELECT a.id AS a_id, min_by(b.id, (list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), b.id)) AS b_id FROM vectors a, vectors b WHERE a.id % 100 = 0 AND a.id <> b.id GROUP BY a.id")
def descriptor_nn(spark, d):
    v = table(spark, d, "vectors")
    return joins.two_nearest(v.where("id % 100 = 0"), v).select("a_id", "b_id")


@query("s03_match_index", "SELECT a AS owner, count(*) AS blocks, sum(inliers)::BIGINT AS inliers, max(created) AS newest FROM variants GROUP BY a")
def match_index(spark, d):
    return table(spark, d, "variants").groupBy(F.col("a").alias("owner")).agg(F.count("*").alias("blocks"), F.sum("inliers").alias("inliers"), F.max("created").alias("newest"))


@query("s16_project_matches", "SELECT a, b, count(*) AS n FROM variants WHERE a IN (SELECT idx FROM images WHERE idx % 2 = 0) GROUP BY a, b HAVING count(*) >= 2")
def project_matches(spark, d):
    some = table(spark, d, "images").where("idx % 2 = 0").select(F.col("idx").alias("a"))
    return table(spark, d, "variants").join(some, "a", "left_semi").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2")


@query("s18_replay_views", "SELECT f.frame, f.kind, i.name FROM frames f JOIN images i ON f.frame % 100 + 1 = i.idx WHERE f.quality > 0.5")
def replay_views(spark, d):
    i = table(spark, d, "images").select("idx", "name")
    return table(spark, d, "frames").where("quality > 0.5").withColumn("idx", F.col("frame") % 100 + 1).join(i, "idx").select("frame", "kind", "name")


@query("s21_laser_shots", "SELECT event_id AS id, value BETWEEN -90 AND 90 AS ok FROM events")
def laser(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    one = F.struct(F.col("event_id").cast("string").alias("id"), F.lit(1.0).alias("time"), F.col("value").alias("latitude"), F.lit(10.0).alias("longitude"), F.lit(1.0).alias("radius"))
    shots = formats.laser_shots(e.select(F.to_json(F.struct(F.array(one).alias("shots"))).alias("text")))
    return shots.select(F.col("id").cast("long").alias("id"), (F.size("errors") == 0).alias("ok"))


@query("s22_control_network", "SELECT 'P' || s_suppkey AS point, 'Free' AS kind, 2::INT AS measures FROM supplier")
def network(spark, d):
    text = F.concat(F.lit("Object = ControlNetwork\n"), F.lit("Object = ControlPoint\n PointType = Free\n PointId = P"), F.col("s_suppkey").cast("string"), F.lit("\n SerialNumber = A/1\n SerialNumber = B/2\nEnd_Object\n"))
    return formats.control_network(spark.read.parquet(f"{d}/supplier.parquet").select(text.alias("text"))).select("point", "kind", "measures")


@query("k13_marker_csv", "SELECT role || ',' || count(*) AS line FROM residuals GROUP BY role")
def marker_csv(spark, d):
    n = table(spark, d, "residuals").groupBy("role").agg(F.count("*").alias("n"))
    return n.select(F.to_csv(F.struct("role", "n")).alias("line"))


@query("k11_report_document", "SELECT CAST(to_json(struct_pack(points := count(*), longest := max(length))) AS VARCHAR) AS json FROM sparse")
def report_document(spark, d):
    from fieldmesh.sources.writers import report

    return report(table(spark, d, "sparse").agg(F.count("*").alias("points"), F.max("length").alias("longest")))


@query("x_component_sizes", "WITH e AS (SELECT DISTINCT a AS node FROM chain UNION SELECT b FROM chain), g AS (SELECT node, max(CASE WHEN node NOT IN (SELECT b FROM chain) THEN node END) OVER (ORDER BY node) AS root FROM e) SELECT root, count(*) AS n FROM g GROUP BY root")
def component_sizes(spark, d):
    return aggregates.histogram(graph.components(table(spark, d, "chain")), [], "root")




@query(
    "f03_normal_consistency",
    f"""WITH u AS (SELECT id, x, y, z, rank + 1 AS a, z + 1 AS b, x AS c, sqrt((rank + 1) ** 2 + (z + 1) ** 2 + x * x) AS s FROM points), d AS (SELECT a.id, count(*) AS n, avg(abs(a.a * b.a + a.b * b.b + a.c * b.c) / (a.s * b.s)) AS dot FROM u a JOIN u b ON a.id <> b.id AND {DIST} <= 4 GROUP BY a.id)
    SELECT u.id FROM u LEFT JOIN d ON u.id = d.id WHERE coalesce(n, 0) < 3 OR dot >= 0.97""",
)
def normal_consistency(spark, d):
    p = table(spark, d, "points").select("id", "x", "y", "z", (F.col("rank") + 1).alias("nx"), (F.col("z") + 1).alias("ny"), F.col("x").alias("nz"))
    return filters.normal_consistency(p, 4.0, 0.97).select("id")


@query(
    "p06_ray_ground",
    """WITH g AS (SELECT floor(y)::BIGINT AS r, floor(x)::BIGINT AS c, avg(z) AS z FROM points GROUP BY 1, 2), q AS (SELECT id, x, y FROM points),
    a AS (SELECT q.id, x, y, g.z FROM q LEFT JOIN g ON g.r = floor(y + (100 - 10) / 100 * 0.5::DOUBLE) AND g.c = floor(x + (100 - 10) / 100 * 0.25::DOUBLE)),
    b AS (SELECT a.id, x, y, a.z AS z1, g.z FROM a LEFT JOIN g ON g.r = floor(y + (100 - a.z) / 100 * 0.5::DOUBLE) AND g.c = floor(x + (100 - a.z) / 100 * 0.25::DOUBLE))
    SELECT id, round(CASE WHEN z IS NOT NULL THEN x + (100 - z1) / 100 * 0.25::DOUBLE END, 4) AS gx, round(CASE WHEN z IS NOT NULL THEN y + (100 - z1) / 100 * 0.5::DOUBLE END, 4) AS gy, round(z, 4) AS gz FROM b""",
)
def ray_ground(spark, d):
    p = table(spark, d, "points")
    g = p.groupBy(F.floor("y").alias("r"), F.floor("x").alias("c")).agg(F.avg("z").alias("z"))
    rays = p.select("id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.lit(100.0).alias("oz"), F.lit(0.25).alias("dx"), F.lit(0.5).alias("dy"), F.lit(-100.0).alias("dz"))
    return rounded(grid.ray_ground(rays, g, 10.0, 2))


@query("p13_utm", "SELECT id, round(500000 + 0 * x, 2)::DOUBLE AS east FROM points")
def utm(spark, d):
    east, _ = scalars.utm(F.col("x"), F.lit(9.0), 32)
    return rounded(table(spark, d, "points").select("id", east.alias("east")), 2)


@query("n03_control_fit", "SELECT id, id % 50 <> 0 AS used FROM points")
def control_fit(spark, d):
    from fieldmesh.operators import solvers

    p = table(spark, d, "points").select("id", "x", "y", "z")
    out = scalars.similarity(F.col("x"), F.col("y"), F.col("z"), 2.0, [0, -1, 0, 1, 0, 0, 0, 0, 1], [1, 2, 3])
    moved = p.select("id", "x", "y", "z", (out[0] + F.when(F.col("id") % 50 == 0, 500.0).otherwise(0.0)).alias("u"), out[1].alias("v"), out[2].alias("w"))
    return solvers.control_fit(moved, 60.0)[1].select("id", "used")


PASS = "SELECT x.* FROM {t} x JOIN (SELECT s.r, s.c, med, count(*) AS n, quantile_cont(abs(z - med), 0.5) * 1.4826 AS nmad FROM {t} s JOIN (SELECT r, c, quantile_cont(z, 0.5) AS med FROM {t} GROUP BY r, c) m ON s.r = m.r AND s.c = m.c GROUP BY s.r, s.c, med) k ON x.r = k.r AND x.c = k.c WHERE k.n < 5 OR abs(z - med) <= greatest(0.5, 1.2 * nmad)"


@query("f09_refinement_passes", f"WITH one AS ({PASS.format(t='samples')}), two AS ({PASS.format(t='one')}) SELECT r, c, count(*) AS n FROM two GROUP BY r, c")
def refinement_passes(spark, d):
    s = table(spark, d, "samples")
    return grid.spike_filter(grid.spike_filter(s, k=1.2), k=1.2).groupBy("r", "c").agg(F.count("*").alias("n"))


@query("g12_camera_groups", "WITH t AS (SELECT * FROM chain WHERE n >= 4), e AS (SELECT a AS node FROM t UNION SELECT b FROM t) SELECT node, max(CASE WHEN node NOT IN (SELECT b FROM t) THEN node END) OVER (ORDER BY node) AS root FROM e")
def camera_groups(spark, d):
    tree = graph.spanning_forest(table(spark, d, "chain"))
    return graph.components(tree.where("n >= 4"))
