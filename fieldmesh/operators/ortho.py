"""Orthophotos: which cells of a height grid each image sees, by depth buffers in blocks of pixels, and what they blend to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where an image stands, its rotation (camera to world, by rows), and how far off cells are looked for.
CENTRE, TURN = ["cx", "cy", "cz"], [f"m{i}{j}" for i in range(3) for j in range(3)]


def samples(cells: DataFrame, step: float) -> DataFrame:
    """r, c, z, part of height cells (r, c, z): the top (part 0), and points a step apart down the side to the lowest of the four neighbours, so
    that a wall hides what lies behind it. A cell that drops far has as many points as that takes."""
    near = F.explode(F.array(*[F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])).alias("n")
    low = cells.select("z", near).select("n.r", "n.c", "z").groupBy("r", "c").agg(F.min("z").alias("low"))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("z") - F.col("low")) / step).cast("int"))).alias("part")
    return cells.select("r", "c", "z").join(low, ["r", "c"]).select("r", "c", "z", part).select("r", "c", (F.col("z") - F.col("part") * step).alias("z"), "part")


def seen(points: DataFrame, images: DataFrame, focal: float, width: float, height: float, pixel: float, cell: float = 1.0) -> DataFrame:
    """image, r, c, part, pu, pv, depth, facing of points (r, c, z, part; at x = c cell, y = r cell) that fall into an image's frame.

    Images (image, cx .. cz, m00 .. m22, radius) go to the squares of ground that their radius touches, points to their own; so only
    images near a point meet it. pu, pv: the block of pixels; facing: the cosine between the ray and the image's axis.
    """
    x, y = F.col("c") * cell, F.col("r") * cell
    side = images.agg(F.max("radius")).first()[0]
    if side is None or side <= 0:
        side = 1.0
    reach = [F.explode(F.sequence(F.floor((F.col(a) - F.col("radius")) / side), F.floor((F.col(a) + F.col("radius")) / side))) for a in ("cx", "cy")]
    dealt = images.select("image", *CENTRE, *TURN, "radius", reach[0].alias("sx")).withColumn("sy", reach[1])
    placed = points.withColumns({"x": x, "y": y}).withColumns({"sx": F.floor(F.col("x") / side), "sy": F.floor(F.col("y") / side)})
    met = placed.join(dealt, ["sx", "sy"]).where((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 <= F.col("radius") ** 2)
    off = [F.col(a) - F.col(b) for a, b in zip("xyz", CENTRE)]
    q = [off[0] * F.col(f"m0{k}") + off[1] * F.col(f"m1{k}") + off[2] * F.col(f"m2{k}") for k in range(3)]
    met = met.select("image", "r", "c", "part", *[v.alias(f"q{k}") for k, v in enumerate(q)]).where("q2 > 0")
    u, v = F.col("q0") / F.col("q2") * focal, F.col("q1") / F.col("q2") * focal
    met = met.withColumns({"u": u, "v": v}).where((F.abs("u") <= width / 2) & (F.abs("v") <= height / 2))
    facing = F.col("q2") / F.sqrt(F.col("q0") ** 2 + F.col("q1") ** 2 + F.col("q2") ** 2)
    return met.select("image", "r", "c", "part", F.floor(F.col("u") / pixel).cast("long").alias("pu"), F.floor(F.col("v") / pixel).cast("long").alias("pv"), F.col("q2").alias("depth"), facing.alias("facing"))


def visible(cells: DataFrame, images: DataFrame, focal: float, width: float, height: float, pixel: float, tolerance: float, step: float, cell: float = 1.0) -> DataFrame:
    """image, r, c, pu, pv, depth, facing of cells that an image sees: nothing in their block of pixels is nearer by more than the
    tolerance. Minima of depth are aggregated before cells meet them."""
    points = seen(samples(cells, step), images, focal, width, height, pixel, cell)
    nearest = points.groupBy("image", "pu", "pv").agg(F.min("depth").alias("nearest"))
    tops = seen(cells.select("r", "c", "z", F.lit(0).alias("part")), images, focal, width, height, pixel, cell)
    return tops.join(nearest, ["image", "pu", "pv"]).where(F.col("depth") <= F.col("nearest") + tolerance).drop("nearest", "part")


def blended(found: DataFrame, pixels: DataFrame, cells: DataFrame, power: float = 2.0) -> DataFrame:
    """r, c, value, images of all cells: pixels (image, pu, pv, value) of the images that see a cell, weighted by facing to a power; null where none does."""
    weight = F.pow("facing", F.lit(power))
    shown = found.join(pixels, ["image", "pu", "pv"]).where("value IS NOT NULL AND NOT isnan(value)")
    mixed = shown.groupBy("r", "c").agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"), F.count("*").alias("images"))
    return cells.select("r", "c").join(mixed, ["r", "c"], "left").fillna(0, ["images"])


def mask_hull(voxels: DataFrame, views: DataFrame, masks: DataFrame, pixel: float = 1.0) -> DataFrame:
    """id of voxels (id, x, y, z) that every view (view, focal, cx .. cz, m00 .. m22) has within its mask (view, u, v: the pixels inside). A voxel
    behind a view is outside. Views are few (counted) and go to all tasks; masks, which may be large, meet voxels by an equality."""
    n = views.count()
    if n > 10_000:
        raise ValueError("more views than are sent to every task")
    met = voxels.join(F.broadcast(views), F.lit(True))
    off = [F.col(a) - F.col(b) for a, b in zip("xyz", CENTRE)]
    q = [off[0] * F.col(f"m0{k}") + off[1] * F.col(f"m1{k}") + off[2] * F.col(f"m2{k}") for k in range(3)]
    at = met.select("id", "view", "focal", *[v.alias(f"q{k}") for k, v in enumerate(q)]).where("q2 > 0")
    at = at.select("id", "view", *[F.floor(F.col("focal") * F.col(c) / F.col("q2") / pixel).cast("long").alias(a) for a, c in (("u", "q0"), ("v", "q1"))])
    held = at.join(masks.select("view", "u", "v").distinct(), ["view", "u", "v"], "left_semi")
    return held.groupBy("id").agg(F.count("*").alias("views")).where(F.col("views") == n).select("id")
