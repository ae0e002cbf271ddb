"""Pixel-shaped tables: disparity costs and checks, path aggregation, cross-view consistency, implicit-field and hull voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmesh.operators.graph import components


def cost_volume(left: DataFrame, right: DataFrame, disparities: int, radius: int = 1) -> DataFrame:
    """r, c, d, cost: mean absolute difference (v) over a (2 radius + 1) window along the row, for each disparity."""
    shift = left.select("r", "c", F.col("v").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(disparities - 1))).alias("d")).withColumn("rc", F.col("c") - F.col("d"))
    pixel = shift.join(right.select("r", F.col("c").alias("rc"), F.col("v").alias("b")), ["r", "rc"]).select("r", "c", "d", F.abs(F.col("a") - F.col("b")).alias("e"))
    near = Window.partitionBy("r", "d").orderBy("c").rangeBetween(-radius, radius)
    return pixel.select("r", "c", "d", F.avg("e").over(near).alias("cost"))


def winner(costs: DataFrame) -> DataFrame:
    """r, c, d of the least cost, the smaller disparity among equals."""
    return costs.groupBy("r", "c").agg(F.min_by("d", F.struct("cost", "d")).alias("d"))


def path_costs(costs: DataFrame, small: float, large: float, directions: list[tuple[int, int]] = ((0, 1),)) -> DataFrame:
    """r, c, d, total: the sum over directions (dr, dc) of the cost along lines of pixels in that direction: a pixel's cost
    plus the least of staying, a step of one (small) or more (large), less the best before. Every pixel has the same
    disparities. A line of pixels is a group; it is walked once, all disparities at a time."""
    import numpy as np
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        v = np.stack(pdf["v"].to_numpy())
        out = v.copy()
        for i in range(1, len(v)):
            x = out[i - 1]
            best = x.min()
            padded = np.concatenate([[np.inf], x, [np.inf]])
            out[i] = v[i] + np.minimum(np.minimum(x, best + large), np.minimum(padded[:-2], padded[2:]) + small) - best
        return pdf[["r", "c"]].assign(v=list(out))

    pixels = costs.groupBy("r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "cost"))), lambda x: x["cost"]).alias("v"))
    # pixels on one line share r dc - c dr, and follow one another by r dr + c dc
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("way"), (F.col("r") * dc - F.col("c") * dr).alias("line"), (F.col("r") * dr + F.col("c") * dc).alias("at")) for k, (dr, dc) in enumerate(directions)])).alias("w")
    lines = pixels.select("r", "c", "v", ways).select("r", "c", "v", "w.way", "w.line", "w.at")
    walked = lines.groupBy("way", "line").applyInPandas(walk, "r long, c long, v array<double>")
    return walked.select("r", "c", F.posexplode("v").alias("d", "x")).groupBy("r", "c", "d").agg(F.sum("x").alias("total"))



def left_right_check(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """Pixels whose disparity agrees with the other view's, where it points."""
    other = right.select("r", F.col("c").alias("oc"), F.col("d").alias("od"))
    return left.withColumn("oc", F.col("c") - F.col("d")).join(other, ["r", "oc"]).where(F.abs(F.col("d") - F.col("od")) <= most).select("r", "c", "d")


def speckles(cells: DataFrame, apart: float, least: int) -> DataFrame:
    """Pixels in regions of at least so many, where neighbours in a row or column differ by at most apart."""
    key = lambda r, c: F.col(r) * 1_000_000 + F.col(c)
    a = cells.select("r", "c", "d")
    steps = a.select(F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("d").alias("d0"), F.explode(F.array(F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c")), F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c")))).alias("n"))
    linked = steps.select("r0", "c0", "d0", "n.r", "n.c").join(a, ["r", "c"]).where(F.abs(F.col("d") - F.col("d0")) <= apart)
    found = components(linked.select(key("r0", "c0").alias("a"), key("r", "c").alias("b")), a.select(key("r", "c").alias("node")))
    size = found.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    keep = found.join(size, "root").select("node")
    return a.withColumn("node", key("r", "c")).join(keep, "node", "left_semi").drop("node")


def consistent_views(depths: DataFrame, most: float, least: int) -> DataFrame:
    """Pixels (view, r, c, depth) that at least so many other views agree with, within a share of the depth. A place is seen by few views."""
    a, b = depths.alias("a"), depths.alias("b")
    near = a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.view") != F.col("b.view")))
    agree = near.where(F.abs(F.col("a.depth") - F.col("b.depth")) <= most * F.col("a.depth"))
    return agree.groupBy("a.view", "a.r", "a.c").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def fused(depths: DataFrame) -> DataFrame:
    """r, c, depth (upper median of the views), n."""
    v = F.array_sort(F.collect_list("depth"))  # as many values as there are views
    return depths.groupBy("r", "c").agg(F.element_at(v, F.floor(F.count("depth") / 2).cast("int") + 1).alias("depth"), F.count("depth").alias("n"))


def implicit_field(samples: DataFrame, size: float, clip: float) -> DataFrame:
    """Voxels with the weighted mean of clipped distances and the sum of weights."""
    key = [F.floor(F.col(a) / size).alias(f"v{a}") for a in "xyz"]
    d = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("distance") / clip))
    return samples.groupBy(*key).agg((F.sum(F.col("weight") * d) / F.sum("weight")).alias("value"), F.sum("weight").alias("weight"))


def visual_hull(voxels: DataFrame, views: DataFrame) -> DataFrame:
    """Voxels (id) inside every view's silhouette (view, lo, hi on axis x after a turn by angle); views are few."""
    x = F.col("x") * F.cos("angle") + F.col("y") * F.sin("angle")
    seen = voxels.join(F.broadcast(views), F.lit(True)).select("id", ((x >= F.col("lo")) & (x <= F.col("hi"))).alias("inside"))
    return seen.groupBy("id").agg(F.bool_and("inside").alias("inside")).where("inside").select("id")


def consensus(depths: DataFrame, reference: DataFrame, most: float) -> DataFrame:
    """r, c, depth: weighted mean of the depths within most of the reference's, the reference's own weight included."""
    ref = reference.select("r", "c", F.col("depth").alias("anchor"), F.col("weight").alias("own"))
    near = ref.join(depths, ["r", "c"], "left").withColumn("ok", F.coalesce(F.abs(F.col("depth") - F.col("anchor")) <= most, F.lit(False)))
    w = F.when(F.col("ok"), F.col("weight")).otherwise(0.0)
    return near.groupBy("r", "c").agg(((F.sum(w * F.coalesce("depth", F.lit(0.0))) + F.first("own") * F.first("anchor")) / (F.sum(w) + F.first("own"))).alias("depth"))
