"""The registered queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmesh.functions import scalars
from fieldmesh.functions.order_stats import order_statistics, quantiles, quartile_index, robust_spread, upper_median
from fieldmesh.operators import aggregates, filters, graph, grid, joins, mesh, pairs, solvers
from fieldmesh.plans.standins import sql, table
from fieldmesh.sources import readers
from fieldmesh.streaming import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "s04_pair_audit"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_in_binary(df: DataFrame, places: int = 4) -> DataFrame:
    """rounded() as SQL's round does it with doubles: scaled, to the nearest whole number (halves away from 0), scaled back. Spark's round takes the
    shortest decimals of a number for exact, so it rounds up 4.52875, which times 10,000 is less than 45,287.5."""

    def one(c):
        x = F.abs(F.col(c) * 10.0**places)
        whole = F.floor(x).cast("double")
        near = F.when(x < 2.0**52, F.when(x - whole >= 0.5, whole + 1).otherwise(whole)).otherwise(x)
        return F.signum(F.col(c)) * near / 10.0**places + 0.0

    return df.select(*[one(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# pair audit -------------------------------------------------------------------------------------------------------

BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY compatible DESC, passed DESC, inliers DESC, total DESC, created DESC, variant) AS k FROM variants) WHERE k = 1)"


@query(
    "s04_pair_audit",
    f"""WITH {BEST} SELECT a, b, variant, inliers, total, CASE WHEN total IS NOT NULL AND passed AND inliers >= 20 THEN 'verified' WHEN total IS NOT NULL THEN 'failed' ELSE 'missing_statistics' END AS status,
    round(CASE WHEN total > 0 THEN inliers / total ELSE 0 END, 4) AS inlier_ratio FROM best""",
)
def pair_audit(spark, d):
    found = pairs.audit(pairs.best_variants(table(spark, d, "variants")), 20)
    return rounded(found.select("a", "b", "variant", "inliers", "total", "status", "inlier_ratio"))


@query("j14_pair_status_counts", f"WITH {BEST} SELECT CASE WHEN total IS NOT NULL AND passed AND inliers >= 20 THEN 'verified' WHEN total IS NOT NULL THEN 'failed' ELSE 'missing_statistics' END AS status, count(*) AS n FROM best GROUP BY 1")
def pair_status(spark, d):
    return aggregates.histogram(pairs.audit(pairs.best_variants(table(spark, d, "variants")), 20), [], "status")


@query(
    "a35_pair_coverage",
    """SELECT a, b, round(0.5 * (count(DISTINCT least(3, floor(ya * 4)) * 4 + least(3, floor(xa * 4))) / 16.0 + count(DISTINCT least(3, floor(yb * 4)) * 4 + least(3, floor(xb * 4))) / 16.0), 4)::DOUBLE AS coverage FROM pair_matches WHERE inlier GROUP BY a, b""",
)
def pair_coverage(spark, d):
    return rounded(pairs.pair_coverage(table(spark, d, "pair_matches")))


@query("s05_config_prefix_read", "SELECT s_nationkey AS nation, max_by(s_suppkey, s_acctbal) AS newest FROM supplier WHERE starts_with(s_name, 'Supplier#0000000') GROUP BY 1")
def config_prefix(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").where(F.startswith("s_name", F.lit("Supplier#0000000"))).groupBy(F.col("s_nationkey").alias("nation")).agg(F.max_by("s_suppkey", "s_acctbal").alias("newest"))


# grids --------------------------------------------------------------------------------------------------------------

WEIGHT = "(CASE WHEN conf > 0 THEN conf ELSE 1 END) / (CASE WHEN err > 0 THEN greatest(err, 1e-6) ELSE 1 END)"
CELL_Z = {
    "mean": "avg(z)", "min": "min(z)", "max": "max(z)", "median": "quantile_cont(z, 0.5)", "stddev": "stddev_pop(z)", "count": "count(z)::DOUBLE",
    "weighted": f"CASE WHEN sum({WEIGHT}) > 0 THEN sum({WEIGHT} * z) / sum({WEIGHT}) ELSE quantile_cont(z, 0.5) END",
    "p80": "list_sort(list(z))[least(count(z), greatest(1, ceil(0.8 * (count(z) + 1))))::INT]",
}


def _cell(mode: str, z: str):
    @query(f"a01_cell_{mode}", f"SELECT r, c, round({z}, 4) AS z, count(z) AS n, round(avg(conf), 4) AS conf, round(avg(err), 4) AS err FROM samples GROUP BY r, c")
    def cell(spark, d):
        return rounded(grid.cell_aggregate(table(spark, d, "samples"), mode))


for _mode, _z in CELL_Z.items():
    _cell(_mode, _z)


@query(
    "a01_cell_nmad",
    """WITH m AS (SELECT r, c, quantile_cont(z, 0.5) AS med FROM samples GROUP BY r, c) SELECT s.r, s.c, round(quantile_cont(abs(z - med), 0.5) * 1.4826, 4) AS z, count(*) AS n, round(avg(conf), 4) AS conf, round(avg(err), 4) AS err
    FROM samples s JOIN m ON s.r = m.r AND s.c = m.c GROUP BY s.r, s.c""",
)
def cell_nmad(spark, d):
    return rounded(grid.cell_aggregate(table(spark, d, "samples"), "nmad"))


TILES = "tiles AS (SELECT r, c, tile, avg(z) AS z, avg(conf) AS conf, avg(err) AS err FROM samples GROUP BY r, c, tile)"
CONF, INV = "(CASE WHEN conf > 0 THEN conf ELSE 0 END)", "(CASE WHEN err > 0 THEN 1 / greatest(err, 1e-6) ELSE 0 END)"
MOSAIC_Z = {
    "first": "min_by(z, tile)", "last": "max_by(z, tile)", "mean": "avg(z)", "median": "quantile_cont(z, 0.5)", "min": "min(z)", "max": "max(z)",
    "confidence": f"CASE WHEN sum({CONF}) > 0 THEN sum({CONF} * z) / sum({CONF}) ELSE max_by(z, tile) END",
    "inverse_error": f"CASE WHEN sum({INV}) > 0 THEN sum({INV} * z) / sum({INV}) ELSE max_by(z, tile) END",
}


def _mosaic(mode: str, z: str):
    @query(f"u07_mosaic_{mode}", f"WITH {TILES} SELECT r, c, round({z}, 4) AS z, count(*) AS n FROM tiles GROUP BY r, c")
    def mosaic(spark, d):
        tiles = table(spark, d, "samples").groupBy("r", "c", "tile").agg(F.avg("z").alias("z"), F.avg("conf").alias("conf"), F.avg("err").alias("err"))
        return rounded(grid.mosaic(tiles, mode))


for _mode, _z in MOSAIC_Z.items():
    _mosaic(_mode, _z)


def _flag_grid(spark, d, flag):
    return grid.cell_aggregate(table(spark, d, "samples").where(F.col("flag") == flag), "mean")


@query(
    "a09_dem_difference",
    """WITH g AS (SELECT flag, r, c, avg(z) AS z FROM samples GROUP BY flag, r, c), d AS (SELECT x.z - y.z AS d FROM g x JOIN g y ON x.r = y.r AND x.c = y.c WHERE x.flag = 'A' AND y.flag = 'R')
    SELECT round(avg(d), 4) AS mean, round(sqrt(avg(d * d)), 4) AS rmse, count(*) AS n, round(list_sort(list(d))[ceil(0.5 * (count(*) - 1))::INT + 1], 4) AS median, round(list_sort(list(abs(d)))[ceil(0.95 * (count(*) - 1))::INT + 1], 4) AS p95 FROM d""",
)
def dem_difference(spark, d):
    return rounded(grid.difference(_flag_grid(spark, d, "A"), _flag_grid(spark, d, "R")))


@query("j11_same_cell_join", "WITH g AS (SELECT flag, r, c, avg(z) AS z FROM samples GROUP BY flag, r, c) SELECT x.r, x.c, round(x.z, 4) AS a, round(y.z, 4) AS b FROM g x JOIN g y ON x.r = y.r AND x.c = y.c WHERE x.flag = 'A' AND y.flag = 'R'")
def same_cell(spark, d):
    return rounded(_flag_grid(spark, d, "A").select("r", "c", F.col("z").alias("a")).join(_flag_grid(spark, d, "R").select("r", "c", F.col("z").alias("b")), ["r", "c"]))


@query("a08_grid_coverage", "SELECT count(DISTINCT floor(y / 5) * 10 + floor(x / 5))::BIGINT AS occupied, round(count(DISTINCT floor(y / 5) * 10 + floor(x / 5)) / 100.0, 4)::DOUBLE AS coverage FROM points WHERE x >= 0 AND x < 50 AND y >= 0 AND y < 50")
def grid_coverage(spark, d):
    return rounded(grid.coverage(table(spark, d, "points"), 50.0, 50.0, 10, 10))


@query("a05_voxels", "SELECT floor(x / 5)::BIGINT AS vx, floor(y / 5)::BIGINT AS vy, floor(z / 5)::BIGINT AS vz, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, count(*) AS n FROM points GROUP BY 1, 2, 3")
def voxels(spark, d):
    return rounded(grid.voxels(table(spark, d, "points"), 5.0))


@query(
    "a04_bilinear_splat",
    """WITH p AS (SELECT floor(y) AS r, floor(x) AS c, y - floor(y) AS fr, x - floor(x) AS fc, z FROM points), e AS (SELECT r + i AS r, c + j AS c, (CASE i WHEN 1 THEN fr ELSE 1 - fr END) * (CASE j WHEN 1 THEN fc ELSE 1 - fc END) AS w, z
    FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) SELECT r::BIGINT AS r, c::BIGINT AS c, round(sum(w * z) / sum(w), 4) AS z FROM e WHERE w > 0 GROUP BY 1, 2""",
)
def splat(spark, d):
    return rounded(grid.bilinear_splat(table(spark, d, "points")))


FULL = "g AS (SELECT r, c, avg(z) AS z FROM samples GROUP BY r, c)"
NEAR = "(VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)"


@query(
    "w08_hole_fill",
    f"""WITH {FULL}, v AS (SELECT * FROM g WHERE (r * 3 + c) % 4 <> 0), s AS (SELECT r + i AS r, c + j AS c, z, sqrt(i * i + j * j) AS d FROM v, {NEAR} WHERE i <> 0 OR j <> 0),
    f AS (SELECT r, c, sum(z / d) / sum(1 / d) AS f, count(*) AS k FROM s GROUP BY r, c)
    SELECT g.r, g.c, round(CASE WHEN v.z IS NOT NULL THEN v.z WHEN k >= 3 THEN f END, 4) AS z, CASE WHEN v.z IS NULL AND k >= 3 THEN 1 ELSE 0 END AS filled FROM g LEFT JOIN v ON g.r = v.r AND g.c = v.c LEFT JOIN f ON g.r = f.r AND g.c = f.c""",
)
def hole_fill(spark, d):
    full = grid.cell_aggregate(table(spark, d, "samples"), "mean")
    return rounded(grid.fill_holes(full.where("(r * 3 + c) % 4 <> 0"), full))


@query("w09_window_median", f"WITH {FULL}, s AS (SELECT r + i AS r, c + j AS c, z FROM g, {NEAR}), m AS (SELECT r, c, quantile_cont(z, 0.5) AS med FROM s GROUP BY r, c) SELECT g.r, g.c, round(z, 4) AS z, round(med, 4) AS med FROM g JOIN m ON g.r = m.r AND g.c = m.c")
def window_median(spark, d):
    return rounded(grid.window_median(grid.cell_aggregate(table(spark, d, "samples"), "mean")))


@query(
    "f23_local_depth_outliers",
    f"WITH {FULL}, s AS (SELECT r + i AS r, c + j AS c, z FROM g, {NEAR}), m AS (SELECT r, c, quantile_cont(z, 0.5) AS med FROM s GROUP BY r, c) SELECT g.r, g.c, abs(z - med) > 0.3 AS outlier FROM g JOIN m ON g.r = m.r AND g.c = m.c",
)
def local_outliers(spark, d):
    return grid.window_median(grid.cell_aggregate(table(spark, d, "samples"), "mean")).select("r", "c", (F.abs(F.col("z") - F.col("med")) > 0.3).alias("outlier"))


@query(
    "f08_plane_residual",
    f"""WITH {FULL}, s AS (SELECT r + i AS r, c + j AS c, -i::DOUBLE AS u, -j::DOUBLE AS v, z FROM g, {NEAR}), t AS (SELECT r, c, count(*)::DOUBLE AS n, sum(u) AS su, sum(v) AS sv, sum(z) AS sz, sum(u*u) AS suu, sum(v*v) AS svv, sum(u*v) AS suv, sum(u*z) AS suz, sum(v*z) AS svz FROM s GROUP BY r, c),
    w AS (SELECT r, c, suu*(svv*n - sv*sv) - suv*(suv*n - sv*su) + su*(suv*sv - svv*su) AS det, suu*(svv*sz - svz*sv) - suv*(suv*sz - svz*su) + suz*(suv*sv - svv*su) AS top FROM t)
    SELECT g.r, g.c, round(z, 4) AS z, round(CASE WHEN abs(det) > 1e-9 THEN z - top / det END, 4) AS residual FROM g JOIN w ON g.r = w.r AND g.c = w.c""",
)
def plane_residual(spark, d):
    return rounded(grid.plane_residuals(grid.cell_aggregate(table(spark, d, "samples"), "mean")))


@query(
    "f07_spike_filter",
    """WITH m AS (SELECT r, c, quantile_cont(z, 0.5) AS med FROM samples GROUP BY r, c), s AS (SELECT s.r, s.c, med, count(*) AS n, quantile_cont(abs(z - med), 0.5) * 1.4826 AS nmad FROM samples s JOIN m ON s.r = m.r AND s.c = m.c GROUP BY s.r, s.c, med)
    SELECT x.r, x.c, count(*) AS n FROM samples x JOIN s ON x.r = s.r AND x.c = s.c WHERE s.n < 5 OR abs(z - med) <= greatest(0.5, 1.0 * nmad) GROUP BY x.r, x.c""",
)
def spike_filter(spark, d):
    return grid.spike_filter(table(spark, d, "samples"), k=1.0).groupBy("r", "c").agg(F.count("*").alias("n"))


@query("a15_completeness", "WITH e AS (SELECT DISTINCT r, c FROM samples), v AS (SELECT DISTINCT r, c FROM samples WHERE z > 90) SELECT count(v.r) AS valid, count(*) - count(v.r) AS missing, round(count(v.r) / count(*), 4) AS share FROM e LEFT JOIN v ON e.r = v.r AND e.c = v.c")
def completeness(spark, d):
    s = table(spark, d, "samples")
    return rounded(aggregates.completeness(s.where("z > 90").select("r", "c").distinct(), s.select("r", "c").distinct()))


# order statistics and reports ---------------------------------------------------------------------------------------


@query(
    "a07_numeric_summary",
    "SELECT flag, count(z) AS n, round(list_sort(list(z))[floor(0.5 * (count(z) - 1) + 0.5)::INT + 1], 4) AS p50, round(list_sort(list(z))[floor(0.84 * (count(z) - 1) + 0.5)::INT + 1], 4) AS p84, round(list_sort(list(z))[floor(0.95 * (count(z) - 1) + 0.5)::INT + 1], 4) AS p95, round(min(z), 4) AS low, round(max(z), 4) AS high, round(avg(z), 4) AS mean FROM samples GROUP BY flag",
)
def numeric_summary(spark, d):
    return rounded(aggregates.numeric_summary(table(spark, d, "samples"), ["flag"], "z"))


@query("a10_linear_quantiles", "SELECT flag, round(quantile_cont(z, 0.5), 4) AS p50, round(quantile_cont(z, 0.84), 4) AS p84, round(quantile_cont(z, 0.95), 4) AS p95 FROM samples GROUP BY flag")
def linear_quantiles(spark, d):
    return rounded(quantiles(table(spark, d, "samples"), ["flag"], "z", {f"p{int(q * 100)}": q for q in (0.5, 0.84, 0.95)}).drop("n"))


@query("a34_upper_median", "SELECT r, c, count(z) AS n, round(list_sort(list(z))[floor(count(z) / 2)::INT + 1], 4) AS med, round(list_sort(list(z))[least(count(z) - 1, floor(count(z) * 3 / 4))::INT + 1], 4) AS quartile FROM samples GROUP BY r, c")
def upper_medians(spark, d):
    return rounded(order_statistics(table(spark, d, "samples"), ["r", "c"], "z", {"med": upper_median, "quartile": quartile_index}))


@query("f02_robust_spread", "WITH m AS (SELECT flag, quantile_cont(z, 0.5) AS med FROM samples GROUP BY flag) SELECT s.flag, count(z) AS n, round(med, 4) AS med, round(quantile_cont(abs(z - med), 0.5), 4) AS mad, round(quantile_cont(abs(z - med), 0.5) * 1.4826, 4) AS nmad FROM samples s JOIN m ON s.flag = m.flag GROUP BY s.flag, med")
def spread(spark, d):
    return rounded(robust_spread(table(spark, d, "samples"), ["flag"], "z", few=True))


@query("f02_robust_outliers", "WITH m AS (SELECT quantile_cont(z, 0.5) AS med FROM samples), a AS (SELECT quantile_cont(abs(z - med), 0.5) AS mad FROM samples, m) SELECT flag, count(*) AS n FROM samples, m, a WHERE z <= med + 1.0 * 1.4826 * mad GROUP BY flag")
def robust_outliers(spark, d):
    return filters.robust_outliers(table(spark, d, "samples"), "z", 1.0).groupBy("flag").agg(F.count("*").alias("n"))


@query("f10_sigma_outliers", "WITH m AS (SELECT avg(z) AS m, stddev_pop(z) AS s FROM samples) SELECT flag, count(*) AS n FROM samples, m WHERE z <= m + 1.5 * s GROUP BY flag")
def sigma_outliers(spark, d):
    return filters.sigma_outliers(table(spark, d, "samples"), "z", 1.5).groupBy("flag").agg(F.count("*").alias("n"))


@query("a13_residuals", "SELECT role, count(*) AS n, count(*) FILTER (WHERE abs(residual) <= 1 AND role <> 'check') AS inliers, round(avg(abs(residual)), 4) AS mean, round(sqrt(avg(residual * residual)), 4) AS rms, round(max(abs(residual)), 4) AS largest FROM residuals GROUP BY role")
def residual_report(spark, d):
    return rounded(aggregates.residual_statistics(table(spark, d, "residuals"), "role", "residual", 1.0))


@query("k12_control_report", "SELECT role, count(*) AS n, round(avg(residual), 4) AS bias FROM residuals GROUP BY role")
def control_report(spark, d):
    return rounded(table(spark, d, "residuals").groupBy("role").agg(F.count("*").alias("n"), F.avg("residual").alias("bias")))


@query("a23_track_lengths", "SELECT length, count(*) AS tracks FROM (SELECT track, count(*) AS length FROM obs GROUP BY track) GROUP BY length")
def track_lengths(spark, d):
    return aggregates.track_lengths(table(spark, d, "obs"))


@query("a24_funnel", "SELECT count(*) FILTER (WHERE total > 0) AS raw, count(*) FILTER (WHERE passed) AS verified, count(*) FILTER (WHERE passed AND compatible) AS usable FROM variants")
def funnel(spark, d):
    return aggregates.funnel(table(spark, d, "variants"), {"raw": F.col("total") > 0, "verified": F.col("passed"), "usable": F.col("passed") & F.col("compatible")})


@query("a16_provenance", "SELECT flag, tile, count(*) AS n FROM samples GROUP BY flag, tile")
def provenance(spark, d):
    return aggregates.histogram(table(spark, d, "samples"), ["flag"], "tile")


@query("a17_missing_reasons", "SELECT count(*) FILTER (WHERE state = 'view') AS view, count(*) FILTER (WHERE state = 'click') AS click, count(*) FILTER (WHERE state = 'purchase') AS purchase FROM task_events")
def missing_reasons(spark, d):
    return table(spark, d, "task_events").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("view", "click", "purchase")])


@query("a30_mean_error", "SELECT round(avg(reproj), 4) AS mean_error, count(*) AS n FROM sparse WHERE length >= 2")
def mean_error(spark, d):
    return rounded(table(spark, d, "sparse").where("length >= 2").agg(F.avg("reproj").alias("mean_error"), F.count("*").alias("n")))


@query(
    "a20_visibility_histogram",
    """WITH b AS (SELECT flag, least(9, floor((z - 0) / 10.5)) AS b, sum(conf * 100 + 1) AS w FROM samples WHERE z >= 0 AND z <= 105 GROUP BY 1, 2), k AS (SELECT *, sum(w) OVER (PARTITION BY flag ORDER BY b) AS cum, sum(w) OVER (PARTITION BY flag) AS al FROM b)
    SELECT flag, round(min_by((b + 0.5) * 10.5, b) FILTER (WHERE cum * 2 > al), 4) AS med, max_by(b, w)::BIGINT AS top FROM k GROUP BY flag""",
)
def visibility_histogram(spark, d):
    s = table(spark, d, "samples").withColumn("w", F.col("conf") * 100 + 1)
    return rounded(aggregates.weighted_median_bins(s, ["flag"], "z", "w", 0.0, 105.0, 10))


@query("a06_quality_status", "WITH s AS (SELECT flag, avg(z) AS z, max(err) AS e FROM samples GROUP BY flag) SELECT flag, CASE WHEN z > 60 THEN 'blocked' WHEN e > 0.05 THEN 'warn' ELSE 'ok' END AS status FROM s")
def quality_status(spark, d):
    s = table(spark, d, "samples").groupBy("flag").agg(F.avg("z").alias("z"), F.max("err").alias("e"))
    return s.select("flag", aggregates.status([F.col("z") > 60], [F.col("e") > 0.05]).alias("status"))


@query("a29_baseline_comparison", "WITH n AS (SELECT avg(z) AS z, avg(conf) AS conf FROM samples WHERE flag = 'A'), w AS (SELECT avg(z) AS z, avg(conf) AS conf FROM samples WHERE flag = 'N') SELECT 'z' AS metric, round(n.z / w.z, 4) AS ratio, n.z / w.z > 1.001 AS failed FROM n, w UNION ALL SELECT 'conf', round(n.conf / w.conf, 4), n.conf / w.conf > 0.5 FROM n, w")
def baseline(spark, d):
    one = lambda f: table(spark, d, "samples").where(F.col("flag") == f).agg(F.avg("z").alias("z"), F.avg("conf").alias("conf"))
    return rounded(aggregates.baseline_comparison(one("A"), one("N"), {"z": 1.001, "conf": 0.5}))


@query("a33_spacing", "SELECT round(sqrt((max(x) - min(x)) * (max(y) - min(y)) / count(*)), 4) AS spacing FROM points")
def spacing(spark, d):
    return rounded(table(spark, d, "points").agg(F.sqrt((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / F.count("*")).alias("spacing")))


@query("k09_quality_report", "SELECT count(*) AS points, round(avg(reproj), 4) AS error, max(length) AS longest FROM sparse")
def quality_report(spark, d):
    return rounded(table(spark, d, "sparse").agg(F.count("*").alias("points"), F.avg("reproj").alias("error"), F.max("length").alias("longest")))


# filters and gates --------------------------------------------------------------------------------------------------

KEEP = "(reproj IS NULL OR reproj <= 2.0)", "(angle IS NULL OR angle >= 2.0)", "(uncertainty IS NULL OR uncertainty <= 6.0)"


def _rules():
    return [("reproj", filters.keeps("reproj", most=2.0)), ("angle", filters.keeps("angle", least=2.0)), ("nothing", F.lit(False)), ("uncertainty", filters.keeps("uncertainty", most=6.0))]


@query("f01_ordered_filter", f"SELECT id, line FROM sparse WHERE {' AND '.join(KEEP)}")
def ordered_filter(spark, d):
    return filters.ordered_filters(table(spark, d, "sparse"), _rules())[0].select("id", "line")


@query(
    "f01_filter_report",
    f"""SELECT 'reproj' AS step, count(*) FILTER (WHERE NOT {KEEP[0]}) AS removed, false AS undone FROM sparse UNION ALL SELECT 'angle', count(*) FILTER (WHERE {KEEP[0]} AND NOT {KEEP[1]}), false FROM sparse
    UNION ALL SELECT 'nothing', 0, true UNION ALL SELECT 'uncertainty', count(*) FILTER (WHERE {KEEP[0]} AND {KEEP[1]} AND NOT {KEEP[2]}), false FROM sparse""",
)
def filter_report(spark, d):
    return filters.ordered_filters(table(spark, d, "sparse"), _rules())[1]


@query("f15_reason_counts", f"SELECT CASE WHEN NOT {KEEP[0]} THEN 'reproj' WHEN NOT {KEEP[1]} THEN 'angle' WHEN NOT {KEEP[2]} THEN 'uncertainty' END AS reason, count(*) AS n FROM sparse GROUP BY 1")
def reason_counts(spark, d):
    rules = [r for r in _rules() if r[0] != "nothing"]
    return aggregates.histogram(filters.reasons(table(spark, d, "sparse"), rules), [], "reason")


@query("f16_point_filter", "SELECT count(*) AS n, round(sum(reproj), 4) AS total FROM sparse WHERE reproj <= 1.5 AND angle >= 5")
def point_filter(spark, d):
    return rounded(table(spark, d, "sparse").where("reproj <= 1.5 and angle >= 5").agg(F.count("*").alias("n"), F.sum("reproj").alias("total")))


@query("f17_short_tracks", "SELECT track, image, feature FROM (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM obs) WHERE n >= 4")
def short_tracks(spark, d):
    return filters.short_tracks(table(spark, d, "obs"), 4)


@query("u04_duplicate_observations", "WITH o AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY track, image) AS k FROM obs) WHERE k = 1) SELECT track, image, feature FROM (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM o) WHERE n >= 2")
def duplicate_observations(spark, d):
    return filters.conflicting_tracks(table(spark, d, "obs"))


@query("f05_refine_rounds", "SELECT count(*) AS n, max(reproj) AS worst, min(angle) AS narrowest FROM sparse WHERE reproj <= 3.0 AND angle >= 1.0 AND reproj <= 3.0 * 0.92::DOUBLE AND angle >= 1.4 AND reproj <= 3.0 * 0.84::DOUBLE AND angle >= 1.8")
def refine(spark, d):
    return filters.refine_rounds(table(spark, d, "sparse"), 3, 3.0, 1.0).agg(F.count("*").alias("n"), F.max("reproj").alias("worst"), F.min("angle").alias("narrowest"))


@query("f20_frame_roles", "SELECT CASE WHEN quality >= 0.5 THEN 'accept' WHEN quality >= 0.2 THEN 'validation' ELSE 'reject' END AS role, count(*) AS n FROM frames GROUP BY 1")
def frame_roles(spark, d):
    return aggregates.histogram(filters.frame_roles(table(spark, d, "frames"), 0.5, 0.2), [], "role")


@query("f06_voxel_cleanup", "WITH w AS (SELECT *, count(*) OVER v AS n, avg(z) OVER v AS m, stddev_pop(z) OVER v AS s FROM points WINDOW v AS (PARTITION BY floor(x / 10), floor(y / 10), floor(z / 10))) SELECT id FROM w WHERE n >= 3 AND abs(z - m) <= 1.5 * s + 1e-12")
def voxel_cleanup(spark, d):
    return filters.voxel_cleanup(table(spark, d, "points"), 10.0, 3, 1.5).select("id")


@query(
    "f27_topology_gate",
    "SELECT flag, array_to_string(list_filter([CASE WHEN NOT avg(z) <= 40 THEN 'height' END, CASE WHEN NOT count(*) >= 10 THEN 'count' END], lambda x: x IS NOT NULL), ',') AS failed, avg(z) <= 40 AND count(*) >= 10 AS passed FROM samples GROUP BY flag",
)
def topology_gate(spark, d):
    s = table(spark, d, "samples").groupBy("flag").agg(F.avg("z").alias("z"), F.count("*").alias("n"))
    return filters.gate(s, [("height", F.col("z") <= 40), ("count", F.col("n") >= 10)]).select("flag", F.array_join("failed", ",").alias("failed"), "passed")


@query("f28_shot_validation", "SELECT count(*) FILTER (WHERE state NOT IN ('view', 'click', 'purchase')) AS bad_state, count(*) FILTER (WHERE moment IS NULL) AS bad_time, count(*) AS n FROM task_events")
def shot_validation(spark, d):
    e = table(spark, d, "task_events")
    return e.agg(F.count_if(~F.col("state").isin("view", "click", "purchase")).alias("bad_state"), F.count_if(F.col("moment").isNull()).alias("bad_time"), F.count("*").alias("n"))


@query("f29_duplicate_markers", "SELECT track, count(*) AS n FROM obs GROUP BY track HAVING count(DISTINCT image) < count(*)")
def duplicate_markers(spark, d):
    return table(spark, d, "obs").groupBy("track").agg(F.count("*").alias("n"), F.countDistinct("image").alias("k")).where("k < n").drop("k")


@query("g10_weak_edges", "WITH e AS (SELECT a, b, n FROM chain), t AS (SELECT a, b, n / 17 AS ratio FROM chain WHERE n % 3 <> 0) SELECT e.a, e.b, n, round(ratio, 4) AS ratio FROM e LEFT JOIN t ON e.a = t.a AND e.b = t.b WHERE ratio IS NULL OR ratio >= 0.4")
def weak_edges(spark, d):
    e = table(spark, d, "chain")
    return rounded(graph.weak_edges_pruned(e, e.where("n % 3 <> 0").select("a", "b", (F.col("n") / 17).alias("ratio")), 0.4))


# joins --------------------------------------------------------------------------------------------------------------


@query("j01_feature_track_join", "SELECT o.track, o.image, count(*) AS n FROM obs o JOIN variants v ON o.image = v.a AND o.feature = v.b GROUP BY 1, 2")
def feature_track(spark, d):
    v = table(spark, d, "variants").select(F.col("a").alias("image"), F.col("b").alias("feature"))
    return table(spark, d, "obs").join(v, ["image", "feature"]).groupBy("track", "image").agg(F.count("*").alias("n"))


@query("j02_both_ways", "SELECT a AS owner, b AS peer, n FROM chain UNION ALL SELECT b, a, n FROM chain")
def both_ways(spark, d):
    return joins.both_ways(table(spark, d, "chain"))


MATCHES = "m AS (SELECT x.image AS image_a, x.feature AS feature_a, y.image AS image_b, y.feature AS feature_b FROM obs x JOIN obs y ON x.track = y.track AND x.image < y.image)"


@query("j03_retained_matches", f"WITH {MATCHES}, o AS (SELECT image, feature, min(track) AS track FROM obs GROUP BY 1, 2 HAVING count(DISTINCT track) = 1) SELECT m.*, p.track FROM m JOIN o p ON m.image_a = p.image AND m.feature_a = p.feature JOIN o q ON m.image_b = q.image AND m.feature_b = q.feature WHERE p.track = q.track")
def retained(spark, d):
    o = table(spark, d, "obs")
    m = o.select("track", F.col("image").alias("image_a"), F.col("feature").alias("feature_a")).join(o.select("track", F.col("image").alias("image_b"), F.col("feature").alias("feature_b")), "track").where("image_a < image_b").drop("track")
    return joins.retained_matches(m, o)


@query("j04_exhaustive_pairs", "SELECT a.idx AS i, b.idx AS j, 'exhaustive' AS source, 10.0::DOUBLE AS priority FROM images a JOIN images b ON a.idx < b.idx")
def exhaustive(spark, d):
    return pairs.exhaustive(table(spark, d, "images"))


@query("j05_band_join", "SELECT a.idx AS i, b.idx AS j, b.idx - a.idx AS gap FROM images a JOIN images b ON b.idx > a.idx AND b.idx <= a.idx + 3")
def band(spark, d):
    return joins.band_pairs(table(spark, d, "images"), 3).withColumn("gap", F.col("gap").cast("long"))


@query("j06_overlap_join", "SELECT a.idx AS i, b.idx AS j, round(1 - abs(a.x - b.x) / greatest(1e-6, 1.2 * (a.radius + b.radius)), 4) AS score FROM images a JOIN images b ON a.idx < b.idx WHERE abs(a.x - b.x) <= greatest(1e-6, 1.2 * (a.radius + b.radius)) AND abs(a.x - b.x) <= 2.5 * 1.2 * a.radius")
def overlap(spark, d):
    return rounded(joins.overlap_pairs(table(spark, d, "images"), 1.2))


DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("j07_nearest", f"SELECT a.id AS a_id, b.id AS b_id, round({DIST}, 4) AS d FROM queries a JOIN points b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) = 1")
def nearest_one(spark, d):
    return rounded(joins.nearest(table(spark, d, "queries"), table(spark, d, "points"), 1, 2.0, itself=False).select("a_id", "b_id", "d"))


@query("j08_knn", f"SELECT a.id AS a_id, b.id AS b_id, round({DIST}, 4) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id)::INT AS rank FROM queries a JOIN (SELECT id, x, y, z FROM points) b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) <= 5")
def knn(spark, d):
    return rounded(joins.nearest(table(spark, d, "queries"), table(spark, d, "points"), 5, 2.0, itself=False))


@query("j09_radius_search", f"SELECT a.id AS a_id, b.id AS b_id, round({DIST}, 4) AS d FROM queries a JOIN points b ON {DIST} <= 4")
def radius_search(spark, d):
    return rounded(joins.radius_pairs(table(spark, d, "queries"), table(spark, d, "points"), 4.0))


@query("f04_density", f"SELECT a.id, count(*) AS n FROM points a JOIN points b ON {DIST} <= 3 GROUP BY a.id HAVING count(*) >= 4")
def density(spark, d):
    return joins.radius_counts(table(spark, d, "points"), 3.0).where("n >= 4")


@query("f11_radius_outliers", f"WITH n AS (SELECT a.id, count(b.id) AS n FROM points a LEFT JOIN points b ON a.id <> b.id AND {DIST} <= 1.6 GROUP BY a.id) SELECT id, n FROM n WHERE n < 3")
def radius_outliers(spark, d):
    return filters.radius_outliers(table(spark, d, "points"), 1.6, 3)


@query("j10_plane_weight", f"SELECT a.id AS a_id, b.id AS b_id, round(greatest(0.1, greatest(0, least(1, 1 - {DIST} / 4)) * greatest(0, least(1, 1 - (b.id % 10) / 10))), 4) AS weight FROM queries a JOIN points b ON a.id <> b.id AND {DIST} <= 4 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) = 1")
def plane_weight(spark, d):
    n = joins.nearest(table(spark, d, "queries"), table(spark, d, "points"), 1, 2.0, itself=False).where("d <= 4")
    return rounded(n.select("a_id", "b_id", scalars.plane_weight(F.col("d"), 4.0, (F.col("b_id") % 10).cast("double"), 10.0, 0.1).alias("weight")))


L2 = "round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6)"


@query(
    "f12_mutual_ratio",
    f"""WITH d AS (SELECT a.id AS a, b.id AS b, {L2} AS d FROM vectors a, vectors b WHERE a.id % 100 = 0 AND a.id <> b.id),
    f AS (SELECT a, min_by(b, (d, b)) AS b, min(d) AS d1, list_sort(list(d))[2] AS d2 FROM d GROUP BY a), e AS (SELECT a.id AS a, b.id AS b, {L2} AS d FROM vectors a, vectors b WHERE a.id IN (SELECT b FROM f) AND a.id <> b.id),
    k AS (SELECT a AS b, min_by(b, (d, b)) AS a, min(d) AS e1, list_sort(list(d))[2] AS e2 FROM e GROUP BY a), m AS (SELECT f.a, f.b, d1, d2, greatest(sqrt(d1 / d2), sqrt(e1 / e2)) AS ratio FROM f JOIN k ON f.a = k.a AND f.b = k.b),
    q AS (SELECT CASE WHEN count(*) < 64 THEN 0.98 ELSE least(0.98, greatest(0.78, list_sort(list(ratio))[least(count(*) - 1, count(*) * 3 // 4) + 1] + 0.02)) END AS most FROM m)
    SELECT a AS a_id, b AS b_id, round(d1, 4) AS d1, round(d2, 4) AS d2 FROM m, q WHERE ratio <= most""",
)
def mutual_ratio(spark, d):
    v = table(spark, d, "vectors")
    forward = joins.two_nearest(v.where("id % 100 = 0"), v)  # the query set against all rows
    matched = v.join(F.broadcast(forward.select(F.col("b_id").alias("id")).distinct()), "id", "left_semi")
    return rounded(joins.unambiguous(forward, joins.two_nearest(matched, v)))


SHARED = "s AS (SELECT x.image AS a, y.image AS b, count(*) AS n FROM (SELECT DISTINCT track, image FROM obs) x JOIN (SELECT DISTINCT track, image FROM obs) y ON x.track = y.track AND x.image < y.image GROUP BY 1, 2)"


@query("j12_shared_tracks", f"WITH {SHARED} SELECT a, b, n FROM s")
def shared(spark, d):
    return joins.shared_tracks(table(spark, d, "obs"))


@query("j13_visible_in_three", "SELECT track FROM obs GROUP BY track HAVING count(DISTINCT image) >= 3 AND count(DISTINCT image) FILTER (WHERE image % 10 = 0) >= 1")
def visible_in(spark, d):
    return table(spark, d, "obs").groupBy("track").agg(F.countDistinct("image").alias("k"), F.count_if(F.col("image") % 10 == 0).alias("r")).where("k >= 3 and r >= 1").select("track")


@query("j15_alias_join", "SELECT i.idx, v.n FROM images i JOIN (SELECT a, count(*) AS n FROM variants GROUP BY a) v ON i.idx = v.a")
def alias_join(spark, d):
    v = table(spark, d, "variants").groupBy(F.col("a").alias("idx")).agg(F.count("*").alias("n"))
    return table(spark, d, "images").select("idx").join(v, "idx")


@query("j17_marker_merge", "WITH m AS (SELECT a AS id, n FROM chain WHERE a % 2 = 0), d AS (SELECT a AS id, n + 100 AS n FROM chain WHERE a % 3 = 0) SELECT coalesce(m.id, d.id) AS id, coalesce(m.n, d.n) AS n, CASE WHEN m.id IS NULL THEN 'detected' WHEN d.id IS NULL THEN 'manual' ELSE 'both' END AS origin FROM m FULL JOIN d ON m.id = d.id")
def marker_merge(spark, d):
    c = table(spark, d, "chain")
    m, e = c.where("a % 2 = 0").select(F.col("a").alias("id"), "n").alias("m"), c.where("a % 3 = 0").select(F.col("a").alias("id"), (F.col("n") + 100).alias("n")).alias("e")
    origin = F.when(F.col("m.id").isNull(), "detected").when(F.col("e.id").isNull(), "manual").otherwise("both")
    return m.join(e, F.col("m.id") == F.col("e.id"), "full").select(F.coalesce("m.id", "e.id").alias("id"), F.coalesce("m.n", "e.n").alias("n"), origin.alias("origin"))


@query("x_as_of_join", "SELECT l.run, l.moment, l.seq, r.seq AS last_view FROM task_events l ASOF LEFT JOIN (SELECT run, moment, max(seq) AS seq FROM task_events WHERE state = 'view' GROUP BY 1, 2) r ON l.run = r.run AND l.moment >= r.moment")
def as_of(spark, d):
    e = table(spark, d, "task_events")
    views = e.where("state = 'view'").groupBy("run", "moment").agg(F.max("seq").alias("last_view"))
    return joins.as_of(e.select("run", "moment", "seq"), views, "run", "moment", "last_view")


# pair planning and ranking -----------------------------------------------------------------------------------------

CANDIDATES = "c AS (SELECT a.idx AS i, b.idx AS j, 'exhaustive' AS source, 10.0 AS priority FROM images a JOIN images b ON a.idx < b.idx AND b.idx < a.idx + 6 UNION ALL SELECT a.idx, b.idx, 'sequence', 40.0 + 10 * (1 - (b.idx - a.idx) / 3.0) FROM images a JOIN images b ON b.idx > a.idx AND b.idx <= a.idx + 2)"


def _candidates(spark, d):
    items = table(spark, d, "images")
    wide = joins.band_pairs(items, 5).select("i", "j", F.lit("exhaustive").alias("source"), F.lit(pairs.EXHAUSTIVE).alias("priority"))
    near = joins.band_pairs(items, 2).select("i", "j", F.lit("sequence").alias("source"), (pairs.SEQUENCE + pairs.SEQUENCE_SCORE * (1 - F.col("gap") / 3.0)).alias("priority"))
    return pairs.union_of_sources(wide, near)


@query("j19_union_of_sources", f"WITH {CANDIDATES} SELECT i, j, round(sum(priority), 4)::DOUBLE AS priority, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM c GROUP BY i, j")
def union_of_sources(spark, d):
    return rounded(_candidates(spark, d))


@query("t01_pair_limit", f"WITH {CANDIDATES} SELECT i, j, round(sum(priority), 4)::DOUBLE AS priority FROM c GROUP BY i, j ORDER BY priority DESC, i, j LIMIT 50")
def pair_limit(spark, d):
    return rounded(pairs.limited(_candidates(spark, d), 50).select("i", "j", "priority"))


@query("t02_guided_plan", "SELECT a, b, n, CASE WHEN n % 3 = 0 THEN 'bridge' WHEN n % 3 = 1 THEN 'weak' ELSE 'other' END AS reason, (CASE WHEN n % 3 = 0 THEN 200 WHEN n % 3 = 1 THEN greatest(0, 160 - n) ELSE 120 END)::DOUBLE AS priority FROM chain ORDER BY priority DESC, a, b LIMIT 40")
def guided_plan(spark, d):
    c = table(spark, d, "chain").withColumn("reason", F.when(F.col("n") % 3 == 0, "bridge").when(F.col("n") % 3 == 1, "weak").otherwise("other"))
    return pairs.guided_plan(c, 40)


@query("t05_best_candidate", "SELECT tile, max_by(id, (z > 50, conf, -err, id)) AS best FROM samples GROUP BY tile")
def best_candidate(spark, d):
    return table(spark, d, "samples").groupBy("tile").agg(F.max_by("id", F.struct(F.col("z") > 50, "conf", -F.col("err"), "id")).alias("best"))


@query("t08_stride_sample", "SELECT frame FROM (SELECT frame, row_number() OVER (ORDER BY frame) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT frame FROM frames)) WHERE (k - 1) % ceil(n / 100)::BIGINT = 0")
def stride(spark, d):
    return pairs.stride_sample(table(spark, d, "frames").select("frame").distinct(), "frame", 100)


SCORES = f"WITH {SHARED}, e AS (SELECT a AS ref, b AS src, n FROM s UNION ALL SELECT b, a, n FROM s), q AS (SELECT ref, src, n AS common, n % 7 AS score, n > 3 AS verified, n * 2 AS inliers, n % 5 AS tracks FROM e)"


def _scores(spark, d):
    e = joins.both_ways(joins.shared_tracks(table(spark, d, "obs"))).select(F.col("owner").alias("ref"), F.col("peer").alias("src"), "n")
    return e.select("ref", "src", F.col("n").alias("common"), (F.col("n") % 7).alias("score"), (F.col("n") > 3).alias("verified"), (F.col("n") * 2).alias("inliers"), (F.col("n") % 5).alias("tracks"))


@query("w01_rank_sources", f"{SCORES} SELECT ref, src, row_number() OVER (PARTITION BY ref ORDER BY score DESC, common DESC, src)::INT AS rank FROM q QUALIFY rank <= 5")
def rank_sources(spark, d):
    return pairs.ranked_sources(_scores(spark, d), 5).select("ref", "src", "rank")


@query("w04_source_planner", f"{SCORES} SELECT ref, src, row_number() OVER (PARTITION BY ref ORDER BY verified DESC, score DESC, inliers DESC, tracks DESC, abs(ref - src), src)::INT AS rank FROM q WHERE score >= 2 QUALIFY rank <= 4")
def source_planner(spark, d):
    return pairs.planned_sources(_scores(spark, d), 4, 2).select("ref", "src", "rank")


@query("w02_nearest_indices", "SELECT a.idx AS ref, b.idx AS src, row_number() OVER (PARTITION BY a.idx ORDER BY abs(b.idx - a.idx), b.idx)::INT AS rank FROM images a JOIN images b ON b.idx <> a.idx AND abs(b.idx - a.idx) <= 3 QUALIFY rank <= 3")
def nearest_indices(spark, d):
    return pairs.nearest_indices(table(spark, d, "images"), 3)


@query("w03_fusion_window", "SELECT run, seq, count(*) OVER (PARTITION BY run ORDER BY moment, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS frames FROM task_events")
def fusion_window(spark, d):
    from pyspark.sql.window import Window

    return table(spark, d, "task_events").select("run", "seq", F.count("*").over(Window.partitionBy("run").orderBy("moment", "seq").rowsBetween(-2, 2)).alias("frames"))


@query("w05_top_connected", f"WITH {SHARED}, e AS (SELECT a AS image, b AS peer, n FROM s UNION ALL SELECT b, a, n FROM s) SELECT image, peer, n FROM e QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC, peer) <= 3")
def top_connected(spark, d):
    from pyspark.sql.window import Window

    e = joins.both_ways(joins.shared_tracks(table(spark, d, "obs"))).toDF("image", "peer", "n")
    return e.withColumn("k", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("n"), "peer"))).where("k <= 3").drop("k")


@query("w06_knn_network", f"WITH {SHARED}, e AS (SELECT a AS x, b AS y, n FROM s UNION ALL SELECT b, a, n FROM s), t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY x ORDER BY n DESC, y) <= 2) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, n FROM t")
def knn_network(spark, d):
    return graph.knn_network(joins.shared_tracks(table(spark, d, "obs")), 2)


@query("w13_subpixel", "SELECT run, seq, round(CASE WHEN p - 2 * v + q <> 0 THEN 0.5 * (p - q) / (p - 2 * v + q) END, 4) AS shift FROM (SELECT user_id::BIGINT AS run, event_id::BIGINT AS seq, value AS v, lag(value) OVER w AS p, lead(value) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def subpixel(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("run").orderBy("seq")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("run"), F.col("event_id").cast("long").alias("seq"), F.col("value").alias("v"))
    e = e.withColumn("p", F.lag("v").over(w)).withColumn("q", F.lead("v").over(w))
    bend = F.col("p") - 2 * F.col("v") + F.col("q")
    return rounded(e.select("run", "seq", F.when(bend != 0, 0.5 * (F.col("p") - F.col("q")) / bend).alias("shift")))


@query("w14_winner_takes_all", "SELECT r, c, min_by(tile, (z, tile)) AS tile FROM samples GROUP BY r, c")
def winner(spark, d):
    return table(spark, d, "samples").groupBy("r", "c").agg(F.min_by("tile", F.struct("z", "tile")).alias("tile"))


@query("a22_weights", "SELECT a, b, n, round(n / (SELECT max(n) FROM chain), 4)::DOUBLE AS weight FROM chain")
def weights(spark, d):
    return rounded(aggregates.normalised_weights(table(spark, d, "chain"), "n"))


# sets ---------------------------------------------------------------------------------------------------------------


@query("u01_cloud_merge", "SELECT id, x, y, z FROM points UNION ALL SELECT id, x, y, z FROM queries")
def cloud_merge(spark, d):
    return table(spark, d, "points").select("id", "x", "y", "z").unionByName(table(spark, d, "queries"))


@query("u02_match_normalise", "SELECT a, b, min(variant) AS variant FROM variants GROUP BY a, b")
def match_normalise(spark, d):
    return table(spark, d, "variants").groupBy("a", "b").agg(F.min("variant").alias("variant"))


@query("u05_pair_keys", r"SELECT least(l_returnflag, l_linestatus) || '|' || greatest(l_returnflag, l_linestatus) AS pair_key, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1")
def pair_keys(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(pairs.pair_key("l_returnflag", "l_linestatus").alias("pair_key")).agg(F.min("l_orderkey").alias("first_seen"))


@query("u06_vertex_weld", "WITH k AS (SELECT id, round(x / 10)::BIGINT AS kx, round(y / 10)::BIGINT AS ky, round(z / 10)::BIGINT AS kz FROM points) SELECT id AS vid, min(id) OVER (PARTITION BY kx, ky, kz) AS \"to\" FROM k")
def weld(spark, d):
    return mesh.welded(table(spark, d, "points").withColumnRenamed("id", "vid"), 10.0)


# graphs -------------------------------------------------------------------------------------------------------------

ISLANDS = "e AS (SELECT DISTINCT a AS node FROM chain UNION SELECT b FROM chain), f AS (SELECT node, node NOT IN (SELECT b FROM chain) AS starts FROM e), g AS (SELECT node, max(CASE WHEN starts THEN node END) OVER (ORDER BY node) AS root FROM f)"


@query("g02_components", f"WITH {ISLANDS} SELECT node, root FROM g")
def chain_components(spark, d):
    return graph.components(table(spark, d, "chain"))


@query("a14_graph_diagnostics", f"WITH {ISLANDS} SELECT count(*) AS nodes, count(DISTINCT root) AS components, (SELECT count(*) FROM chain) AS edges FROM g")
def graph_diagnostics(spark, d):
    e = table(spark, d, "chain")
    one = graph.components(e).agg(F.count("*").alias("nodes"), F.countDistinct("root").alias("components"))
    return one.join(F.broadcast(e.agg(F.count("*").alias("edges"))), F.lit(True))


@query("f22_small_components", f"WITH {ISLANDS} SELECT node, root FROM g QUALIFY count(*) OVER (PARTITION BY root) >= 5")
def small_components(spark, d):
    from pyspark.sql.window import Window

    found = graph.components(table(spark, d, "chain"))
    return found.withColumn("n", F.count("*").over(Window.partitionBy("root"))).where("n >= 5").drop("n")


@query("a21_degrees", "SELECT node, count(*) AS degree, sum(n)::BIGINT AS weight FROM (SELECT a AS node, n FROM chain UNION ALL SELECT b, n FROM chain) GROUP BY node")
def degrees(spark, d):
    return graph.degrees(table(spark, d, "chain"))


@query("g06_spanning_forest", "SELECT a, b, n FROM chain")
def spanning_forest(spark, d):
    return graph.spanning_forest(table(spark, d, "chain"))  # the stand-in is a forest of paths, so all of it stays


@query("g07_strong_core", "SELECT a, b, n FROM chain")
def strong_core(spark, d):
    return graph.strong_core(table(spark, d, "chain"), 3)  # strong edges alone would split paths, so all stay


@query("g09_index_network", "SELECT a, b, n FROM s WHERE b - a <= 4".replace("FROM s", f"FROM (WITH {SHARED} SELECT * FROM s)"))
def index_network(spark, d):
    return joins.shared_tracks(table(spark, d, "obs")).where("b - a <= 4")


@query("g03_tracks")
def feature_tracks(spark, d):
    o = table(spark, d, "obs")
    m = o.select("track", F.col("image").alias("image_a"), F.col("feature").alias("feature_a")).join(o.select("track", F.col("image").alias("image_b"), F.col("feature").alias("feature_b")), "track").where("image_a < image_b")
    return graph.tracks(m.drop("track"))


# meshes -------------------------------------------------------------------------------------------------------------


@query("a12_mesh_topology", "SELECT 441::BIGINT AS vertices, 1240::BIGINT AS edges, 800::BIGINT AS faces, 80::BIGINT AS boundary, 0::BIGINT AS non_manifold, 1::BIGINT AS euler")
def mesh_topology(spark, d):
    return mesh.topology(*mesh.grid_mesh(spark, 20))


@query("a11_mesh_components", "SELECT 0::BIGINT AS root, 800::BIGINT AS faces")
def mesh_components(spark, d):
    return mesh.face_components(mesh.grid_mesh(spark, 20)[1])


@query("f25_clean_faces", "SELECT count(*) AS faces FROM range(800)")
def clean_faces(spark, d):
    vertex, face = mesh.grid_mesh(spark, 20)
    doubled = face.unionByName(face.select((F.col("fid") + 800).alias("fid"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"))).unionByName(face.select((F.col("fid") + 1600).alias("fid"), "v0", F.col("v0").alias("v1"), "v2"))
    return mesh.clean_faces(vertex, doubled).agg(F.count("*").alias("faces"))


# scalars ------------------------------------------------------------------------------------------------------------


@query("p01_similarity", "SELECT id, round(2 * (0 * x - 1 * y + 0 * z) + 1, 4)::DOUBLE AS x, round(2 * (1 * x + 0 * y + 0 * z) + 2, 4)::DOUBLE AS y, round(2 * z + 3, 4)::DOUBLE AS z FROM points")
def similarity(spark, d):
    p = table(spark, d, "points")
    out = scalars.similarity(F.col("x"), F.col("y"), F.col("z"), 2.0, [0, -1, 0, 1, 0, 0, 0, 0, 1], [1, 2, 3])
    return rounded(p.select("id", *[c.alias(a) for c, a in zip(out, "xyz")]))


@query("p02_projection", "SELECT id, round(CASE WHEN z > 0 THEN 100 * x / z + 320 END, 4) AS u, round(CASE WHEN z > 0 THEN 100 * y / z + 240 END, 4) AS v, coalesce(z > 0 AND 100 * x / z + 320 < 640 AND 100 * y / z + 240 < 480 AND 100 * x / z + 320 >= 0 AND 100 * y / z + 240 >= 0, false) AS visible FROM points")
def projection(spark, d):
    u, v = scalars.project(F.col("x"), F.col("y"), F.col("z"), 100.0, 100.0, 320.0, 240.0)
    return rounded(table(spark, d, "points").select("id", u.alias("u"), v.alias("v"), scalars.visible(u, v, 640.0, 480.0).alias("visible")))


@query("p03_unprojection", "SELECT id, round((x - 320) * z / 100, 4) AS x, round((y - 240) * z / 100, 4) AS y, z FROM points WHERE id % 2 = 0 AND z BETWEEN 1 AND 20")
def unprojection(spark, d):
    p = table(spark, d, "points").where("id % 2 = 0 and z between 1 and 20")
    return rounded(p.select("id", *[c.alias(a) for c, a in zip(scalars.unproject(F.col("x"), F.col("y"), F.col("z"), 100.0, 100.0, 320.0, 240.0), "xyz")]))


@query("p04_disparity", "SELECT id, round(CASE WHEN z > 0 THEN 700 * 0.5::DOUBLE / z END, 4) AS depth FROM points")
def disparity(spark, d):
    return rounded(table(spark, d, "points").select("id", scalars.disparity_depth(F.col("z"), 700.0, 0.5).alias("depth")))


@query("p05_ray_plane", "SELECT id, round(CASE WHEN z > 0 THEN x * (50 / z) END, 4) AS gx, round(CASE WHEN z > 0 THEN y * (50 / z) END, 4) AS gy FROM points")
def ray_plane(spark, d):
    g = scalars.ray_plane([F.lit(0.0)] * 3, [F.col("x"), F.col("y"), F.col("z")], 50.0)
    return rounded(table(spark, d, "points").select("id", g[0].alias("gx"), g[1].alias("gy")))


@query("p07_ray_sphere", "SELECT id, round(200 / sqrt(x * x + y * y + z * z), 4) AS s FROM points")
def ray_sphere(spark, d):
    return rounded(table(spark, d, "points").select("id", scalars.ray_sphere([F.lit(0.0)] * 3, [F.col("x"), F.col("y"), F.col("z")], 200.0).alias("s")))


@query("p10_body_fixed", "SELECT id, round(1000 * cos(radians(x)) * cos(radians(y)), 4) AS bx, round(1000 * cos(radians(x)) * sin(radians(y)), 4) AS bj, round(1000 * sin(radians(x)), 4) AS bz FROM points")
def body_fixed(spark, d):
    b = scalars.body_fixed(F.col("x"), F.col("y"), F.lit(1000.0))
    return rounded(table(spark, d, "points").select("id", b[0].alias("bx"), b[1].alias("bj"), b[2].alias("bz")))


@query("p11_map_projection", "SELECT id, round(100 * radians(y) * cos(radians(x)), 4) AS su, round(100 * radians(x), 4) AS sv, round(100 * ln(tan(0.7853981633974483 + radians(x) / 2)), 4) AS mv FROM points")
def map_projection(spark, d):
    s, m = scalars.map_projection("sinusoidal", F.col("x"), F.col("y"), 100.0), scalars.map_projection("mercator", F.col("x"), F.col("y"), 100.0)
    return rounded(table(spark, d, "points").select("id", s[0].alias("su"), s[1].alias("sv"), m[1].alias("mv")))


@query("p12_units", "SELECT id, round(CASE id % 3 WHEN 0 THEN x WHEN 1 THEN x * 1000 ELSE x * 0.3048::DOUBLE END, 4)::DOUBLE AS metres FROM points")
def units(spark, d):
    unit = F.when(F.col("id") % 3 == 0, "m").when(F.col("id") % 3 == 1, " KM").otherwise("ft")
    return rounded(table(spark, d, "points").select("id", scalars.metres(F.col("x"), unit).alias("metres")))


@query("p16_text", "SELECT s_suppkey AS id, lower(trim(s_name)) AS low, ends_with(lower(s_name), '7') AS seven FROM supplier")
def text(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.lower(F.trim("s_name")).alias("low"), scalars.ends_with_any_case(F.col("s_name"), F.lit("7")).alias("seven"))


@query("p17_numbers", r"SELECT event_id, list_sum(list_transform(regexp_extract_all(props, '([-+]?[0-9]+(?:\.[0-9]+)?)', 1), lambda x: x::DOUBLE)) AS total FROM events")
def numbers(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.aggregate(scalars.numbers(F.col("props")), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("p19_flags", "SELECT count(*) FILTER (WHERE l_linenumber & 1 <> 0) AS inlier, count(*) FILTER (WHERE l_linenumber & 2 <> 0) AS track, count(*) FILTER (WHERE l_linenumber & 4 <> 0) AS masked FROM lineitem")
def flags(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").agg(*[F.count_if(scalars.has_flag(F.col("l_linenumber"), n)).alias(n) for n in ("inlier", "track", "masked")])


@query("p20_bitset", "SELECT l_returnflag AS flag, bit_or(1::BIGINT << l_linenumber) AS bits, bit_count(bit_or(1::BIGINT << l_linenumber))::INT AS n FROM lineitem GROUP BY 1")
def bitset(spark, d):
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_linenumber").cast("int"))
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("flag")).agg(F.bit_or(bit).alias("bits")).withColumn("n", F.bit_count("bits"))


@query("p21_fingerprint", "SELECT s_suppkey AS id, sha256(concat_ws('|;', s_suppkey::VARCHAR, replace(s_name, '|', '||'), s_nationkey::VARCHAR)) AS hash FROM supplier")
def fingerprints(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("id"), scalars.fingerprint(F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey")).alias("hash"))


@query("p18_json_fields", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_fields(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("p23_calibration", "SELECT id, round(greatest(0, least(1, (x - 10) / 30)), 4)::DOUBLE AS confidence FROM points")
def calibration(spark, d):
    return rounded(table(spark, d, "points").select("id", scalars.calibrated(F.col("x"), 10.0, 40.0).alias("confidence")))


@query("s19_marker_roles", "SELECT CASE WHEN lower(trim(n_name)) IN ('control', 'gcp', 'control_point') THEN 'control' ELSE 'tie' END AS role, count(*) AS n FROM nation GROUP BY 1")
def marker_roles(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").groupBy(readers.role(F.col("n_name")).alias("role")).agg(F.count("*").alias("n"))


# tasks --------------------------------------------------------------------------------------------------------------

# events stand in for steps of tasks: an event's number names one of the ten states
STATE_OF = f"{tasks.STATES!r}[(seq * 7 + CAST(floor(seq / 10) AS BIGINT)) % 10 + 1]"
LEGAL = ", ".join(f"('{a}', '{b}')" for a, to in tasks.TRANSITIONS.items() for b in to)


@query("r07_state_machine", f"WITH t AS (SELECT run, moment, seq, {STATE_OF} AS state FROM task_events), l AS (SELECT run, moment, seq, lag(state) OVER (PARTITION BY run ORDER BY moment, seq) AS before, state FROM t) SELECT run, moment, seq, before, state, before IS NULL OR before = state OR (before, state) IN ({LEGAL}) AS legal FROM l")
def state_machine(spark, d):
    number = (F.col("seq") * 7 + F.floor(F.col("seq") / 10)) % 10
    named = table(spark, d, "task_events").withColumn("state", F.element_at(F.array(*map(F.lit, tasks.STATES)), (number + 1).cast("int")))
    return tasks.checked(named, tasks.transitions(spark))


@query("r06_latest_state", "SELECT run, max_by(state, (moment, seq)) AS state, count(*) AS revision FROM task_events GROUP BY run")
def latest_state(spark, d):
    return tasks.latest(table(spark, d, "task_events"))


@query("r05_resume", "SELECT run FROM task_events GROUP BY run HAVING max_by(state, (moment, seq)) <> 'purchase'")
def resume(spark, d):
    e = table(spark, d, "task_events")
    return tasks.to_resume(e.select("run").distinct(), tasks.latest(e).where("state = 'purchase'").select("run"), ["run"])


@query("r03_admission", "WITH q AS (SELECT o_orderpriority AS pool, o_orderkey % 10 AS priority, o_orderkey AS seq, (o_custkey % 5 + 1)::BIGINT AS demand FROM orders), u AS (SELECT *, sum(demand) OVER (PARTITION BY pool ORDER BY priority DESC, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM q) SELECT pool, count(*) FILTER (WHERE used <= 500) AS admitted, count(*) AS n FROM u GROUP BY pool")
def admission(spark, d):
    q = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("pool"), (F.col("o_orderkey") % 10).alias("priority"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 5 + 1).alias("demand"))
    return tasks.admission(q, 500).groupBy("pool").agg(F.count_if("admitted").alias("admitted"), F.count("*").alias("n"))


@query("x_windowed_counts", "SELECT time_bucket(INTERVAL '1 day', moment) AS start, state, count(*) AS n FROM task_events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return tasks.windowed_counts(table(spark, d, "task_events"), "1 day")


# kernels without SQL ------------------------------------------------------------------------------------------------


@query("f13_line_ransac")
def line_ransac(spark, d):
    pts = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("pair"), F.col("s_suppkey").cast("double").alias("x"), (F.col("s_suppkey") * 2 + F.col("s_acctbal") / 1e6).alias("y"))
    return solvers.line_ransac(pts, ["pair"], 0.05)


@query("u03_greedy_dedupe")
def greedy_dedupe(spark, d):
    return solvers.greedy_by_distance(table(spark, d, "points").withColumn("block", F.floor(F.col("x") / 10)), "block", 3.0).select("id")


TURNS = "t AS (SELECT image, track, feature % 16 AS cell, track % 7 AS length FROM (SELECT image, track, min(feature) AS feature FROM obs GROUP BY 1, 2)), u AS (SELECT *, row_number() OVER (PARTITION BY image, cell ORDER BY length DESC, track) AS turn FROM t), w AS (SELECT image, track FROM u QUALIFY row_number() OVER (PARTITION BY image ORDER BY turn, cell) <= 50)"


def _balanced(spark, d):
    o = table(spark, d, "obs").groupBy("image", "track").agg(F.min("feature").alias("feature"))
    return solvers.balanced_tracks(o.select("image", "track", (F.col("feature") % 16).alias("cell"), (F.col("track") % 7).alias("length")), 50)


@query("w07_track_selection", f"WITH {TURNS} SELECT image, track FROM w")
def track_selection(spark, d):
    return _balanced(spark, d)


@query("n01_similarity_fit")
def similarity_fit(spark, d):
    p = table(spark, d, "points")
    out = scalars.similarity(F.col("x"), F.col("y"), F.col("z"), 2.0, [0, -1, 0, 1, 0, 0, 0, 0, 1], [1, 2, 3])
    fit = solvers.similarity_fit(p.select("x", "y", "z", *[c.alias(a) for c, a in zip(out, "uvw")]))
    return spark.createDataFrame([(round(fit["scale"], 4), *[round(t, 4) + 0.0 for t in fit["translation"]])], "scale double, tx double, ty double, tz double")


ORACLES["n01_similarity_fit"] = "SELECT 2.0::DOUBLE AS scale, 1.0::DOUBLE AS tx, 2.0::DOUBLE AS ty, 3.0::DOUBLE AS tz"


@query("n02_median_shift", "SELECT 1.5::DOUBLE AS dx, -2.0::DOUBLE AS dy, 0.25::DOUBLE AS dz")
def median_shift(spark, d):
    p = table(spark, d, "points")
    got = solvers.median_shift(p.select("x", "y", "z", (F.col("x") + 1.5).alias("u"), (F.col("y") - 2.0).alias("v"), (F.col("z") + 0.25).alias("w")))
    return spark.createDataFrame([tuple(round(v, 4) for v in got)], "dx double, dy double, dz double")


@query("n05_track_triangulation", "SELECT id AS track, round(x, 3) AS x, round(y, 3) AS y, round(z + 10, 3) AS z, 3::BIGINT AS views FROM points")
def triangulation(spark, d):
    p = table(spark, d, "points").withColumn("z", F.col("z") + 10)
    views = F.explode(F.array(*[F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oy"), F.lit(0.0).alias("oz")) for a, b in ((0.0, 0.0), (30.0, 0.0), (0.0, 30.0))])).alias("o")
    o = p.select(F.col("id").alias("track"), "x", "y", "z", views).select("track", "o.ox", "o.oy", "o.oz", (F.col("x") - F.col("o.ox")).alias("dx"), (F.col("y") - F.col("o.oy")).alias("dy"), (F.col("z") - F.col("o.oz")).alias("dz"))
    return rounded(solvers.triangulated(o), 3)
