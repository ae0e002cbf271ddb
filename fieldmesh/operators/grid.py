"""Gridded elevation: cell aggregation, mosaics, differences, coverage, voxels, hole filling, plane residuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmesh.functions.order_stats import ceil_index, median, order_statistics, p80_index, robust_spread

MODES = ("mean", "min", "max", "weighted", "median", "stddev", "count", "nmad", "p80")


def weight(conf: Column, err: Column) -> Column:
    """Confidence if positive, else 1, over the error (1e-6 at least) where that is positive."""
    w = F.when(conf > 0, conf).otherwise(F.lit(1.0))
    return F.when(err > 0, w / F.greatest(err, F.lit(1e-6))).otherwise(w)


def cell_aggregate(samples: DataFrame, mode: str, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """keys, z, n, conf, err: one of nine ways to merge a cell's samples, with mean confidence and error."""
    keys_ = list(keys)
    base = samples.where(F.col("z").isNotNull() & ~F.isnan("z"))
    common = [F.count("z").alias("n"), F.avg("conf").alias("conf"), F.avg("err").alias("err")]
    w = weight(F.col("conf"), F.col("err"))
    simple = {
        "mean": F.avg("z"), "min": F.min("z"), "max": F.max("z"), "median": median("z"), "stddev": F.stddev_pop("z"), "count": F.count("z").cast("double"),
        "weighted": F.when(F.sum(w) > 0, F.sum(w * F.col("z")) / F.sum(w)).otherwise(median("z")),
    }
    if mode in simple:
        return base.groupBy(*keys_).agg(simple[mode].alias("z"), *common)
    if mode == "nmad":
        special = robust_spread(base, keys_, "z").select(*keys_, F.col("nmad").alias("z"))
    elif mode == "p80":
        special = order_statistics(base, keys_, "z", {"z": p80_index}).select(*keys_, "z")
    else:
        raise ValueError(f"unknown mode {mode}")
    return base.groupBy(*keys_).agg(*common).join(special, keys_).select(*keys_, "z", "n", "conf", "err")


def mosaic(tiles: DataFrame, mode: str) -> DataFrame:
    """r, c, z of overlapping tiles on one grid: first, last, mean, median, min, max, confidence, inverse_error.
    Weighted modes fall back to the last tile's value where the weights sum to nothing."""
    last = F.max_by("z", "tile")
    conf, inverse = F.when(F.col("conf") > 0, F.col("conf")).otherwise(0.0), F.when(F.col("err") > 0, 1 / F.greatest("err", F.lit(1e-6))).otherwise(0.0)
    ways = {
        "first": F.min_by("z", "tile"), "last": last, "mean": F.avg("z"), "median": median("z"), "min": F.min("z"), "max": F.max("z"),
        "confidence": F.when(F.sum(conf) > 0, F.sum(conf * F.col("z")) / F.sum(conf)).otherwise(last),
        "inverse_error": F.when(F.sum(inverse) > 0, F.sum(inverse * F.col("z")) / F.sum(inverse)).otherwise(last),
    }
    return tiles.where("z is not null").groupBy("r", "c").agg(ways[mode].alias("z"), F.count("*").alias("n"))


def valid(value: Column, nodata: float) -> Column:
    """Neither missing, nor not a number, nor within 1e-12 of the no-data value."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value - nodata) > 1e-12)


def difference(candidate: DataFrame, reference: DataFrame, nodata: tuple[float, float] = (-9999.0, -9999.0)) -> DataFrame:
    """n, mean, rmse, median and p95 (index ceil(q (n - 1)) for both) of candidate - reference over common cells."""
    both = candidate.select("r", "c", F.col("z").alias("a")).join(reference.select("r", "c", F.col("z").alias("b")), ["r", "c"])
    d = both.where(valid(F.col("a"), nodata[0]) & valid(F.col("b"), nodata[1])).select((F.col("a") - F.col("b")).alias("d"))
    moments = d.agg(F.avg("d").alias("mean"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    ranks = order_statistics(d, [], "d", {"median": ceil_index(0.5)})
    tail = order_statistics(d.select(F.abs("d").alias("d")), [], "d", {"p95": ceil_index(0.95)}).drop("n")
    return reduce(lambda x, y: x.join(F.broadcast(y), F.lit(True)), [moments, ranks, tail])  # one row each


def coverage(observed: DataFrame, width: float, height: float, rows: int, cols: int) -> DataFrame:
    """Share of a grid's cells that an observation (x, y) falls in; what lies outside is left out."""
    inside = observed.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    cell = F.floor(F.col("y") / (height / rows)) * cols + F.floor(F.col("x") / (width / cols))
    return inside.agg(F.countDistinct(cell).alias("occupied"), (F.countDistinct(cell) / F.lit(float(rows * cols))).alias("coverage"))


def voxels(points: DataFrame, size: float) -> DataFrame:
    """One point for each voxel: centroid and mean colour value. Keys are floors, also below zero."""
    key = [F.floor(F.col(a) / size).alias(f"v{a}") for a in "xyz"]
    return points.groupBy(*key).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count("*").alias("n"))


def neighbours(cells: DataFrame, radius: int = 1, itself: bool = True) -> DataFrame:
    """Every cell's values sent to the cells around it: r, c (receiver), dr, dc, z."""
    steps = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if itself or a or b]
    spread = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])).alias("s")
    return cells.select("r", "c", "z", spread).select((F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), (-F.col("s.dr")).alias("dr"), (-F.col("s.dc")).alias("dc"), "z")


def fill_holes(cells: DataFrame, grid: DataFrame, radius: int = 1, least: int = 3, rounds: int = 1) -> DataFrame:
    """r, c, z, filled. Empty cells of grid take the inverse-distance mean of valid neighbours, if there are enough;
    a round reads what the round before left."""
    now = grid.select("r", "c").join(cells.select("r", "c", "z"), ["r", "c"], "left").withColumn("filled", F.lit(0))
    for k in range(1, rounds + 1):
        distance = F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))
        given = neighbours(now.where("z is not null"), radius, False).groupBy("r", "c").agg((F.sum(F.col("z") / distance) / F.sum(1 / distance)).alias("g"), F.count("*").alias("k"))
        now = now.join(given, ["r", "c"], "left").select(
            "r", "c", F.when(F.col("z").isNotNull(), F.col("z")).when(F.col("k") >= least, F.col("g")).alias("z"), F.when(F.col("z").isNull() & (F.col("k") >= least), F.lit(k)).otherwise(F.col("filled")).alias("filled")
        )
    return now


def window_median(cells: DataFrame, radius: int = 1) -> DataFrame:
    """r, c, z, med: the median of the cells around each, itself included."""
    around = neighbours(cells, radius).groupBy("r", "c").agg(median("z").alias("med"))
    return cells.select("r", "c", "z").join(around, ["r", "c"])


def plane_residuals(cells: DataFrame) -> DataFrame:
    """r, c, z, residual from the least-squares plane through the 3 x 3 cells around; null where that is degenerate."""
    s = neighbours(cells).select("r", "c", F.col("dr").cast("double").alias("u"), F.col("dc").cast("double").alias("v"), "z")
    u, v, z = F.col("u"), F.col("v"), F.col("z")
    sums = s.groupBy("r", "c").agg(
        F.count("*").cast("double").alias("n"), F.sum(u).alias("su"), F.sum(v).alias("sv"), F.sum(z).alias("sz"), F.sum(u * u).alias("suu"), F.sum(v * v).alias("svv"),
        F.sum(u * v).alias("suv"), F.sum(u * z).alias("suz"), F.sum(v * z).alias("svz"),
    )
    n, su, sv, sz, suu, svv, suv, suz, svz = (F.col(x) for x in ("n", "su", "sv", "sz", "suu", "svv", "suv", "suz", "svz"))
    det = suu * (svv * n - sv * sv) - suv * (suv * n - sv * su) + su * (suv * sv - svv * su)
    at = suu * (svv * sz - svz * sv) - suv * (suv * sz - svz * su) + suz * (suv * sv - svv * su)
    height = F.when(F.abs(det) > 1e-9, at / det)
    return cells.select("r", "c", "z").join(sums, ["r", "c"]).select("r", "c", "z", (F.col("z") - height).alias("residual"))


def bilinear_splat(points: DataFrame) -> DataFrame:
    """r, c, z: every point's height shared among the four grid nodes around it."""
    r, c = F.floor("y"), F.floor("x")
    fr, fc = F.col("y") - r, F.col("x") - c
    parts = [F.struct((r + a).alias("r"), (c + b).alias("c"), ((fr if a else 1 - fr) * (fc if b else 1 - fc)).alias("w")) for a in (0, 1) for b in (0, 1)]
    return points.select("z", F.explode(F.array(*parts)).alias("p")).where("p.w > 0").groupBy("p.r", "p.c").agg((F.sum(F.col("p.w") * F.col("z")) / F.sum("p.w")).alias("z"))


def spike_filter(points: DataFrame, keys: tuple[str, ...] = ("r", "c"), least: int = 5, k: float = 3.0, floor: float = 0.5) -> DataFrame:
    """Points within max(floor, k 1.4826 MAD) of their cell's median, in cells of at least so many points; others pass."""
    spread = robust_spread(points, list(keys), "z")
    limit = F.greatest(F.lit(floor), k * F.col("nmad"))
    return points.join(spread, list(keys)).where((F.col("n") < least) | (F.abs(F.col("z") - F.col("med")) <= limit)).select(*points.columns)


def ray_ground(rays: DataFrame, cells: DataFrame, start: float, rounds: int = 3) -> DataFrame:
    """id, gx, gy, gz: where rays (ox, oy, oz, dx, dy, dz) meet the surface, by rounds: meet a level plane, take the height of the
    cell there, and again. Rays that leave the grid, or run level, get nulls."""
    now = rays.withColumn("gz", F.lit(float(start)))
    for _ in range(rounds):
        s = F.when(F.col("dz") != 0, (F.col("gz") - F.col("oz")) / F.col("dz"))
        met = now.withColumn("gx", F.col("ox") + s * F.col("dx")).withColumn("gy", F.col("oy") + s * F.col("dy"))
        at = met.withColumn("r", F.floor("gy")).withColumn("c", F.floor("gx")).drop("gz")
        now = at.join(cells.select("r", "c", F.col("z").alias("gz")), ["r", "c"], "left").drop("r", "c")
    return now.select("id", *[F.when(F.col("gz").isNotNull(), F.col(a)).alias(a) for a in ("gx", "gy", "gz")])
