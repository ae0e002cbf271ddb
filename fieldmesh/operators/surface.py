"""Surfaces out of a sampled field: tetrahedra of a sharded voxel grid, cut where the field passes a level."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a brick's edge, and the bits of a coordinate within a name.
BRICK, BITS = 16, 19
_half = 1 << (BITS - 1)
FACE = "fid long, i long, j long, k long, v0 long, v1 long, v2 long, " + ", ".join(f"{a}{n} double" for n in range(3) for a in "xyz")


def _even(order: tuple[int, ...]) -> bool:
    return sum(a > b for n, a in enumerate(order) for b in order[n + 1 :]) % 2 == 0


def tetrahedra() -> list[np.ndarray]:
    """Six tetrahedra of a cube, all with its main diagonal, as corner offsets; neighbouring cubes split shared sides
    alike. Corners are in positive orientation."""
    out = []
    for axes in permutations(range(3)):
        corners = np.zeros((4, 3), int)
        for n, a in enumerate(axes):
            corners[n + 1 :, a] = 1
        out.append(corners if _even(axes) else corners[[0, 2, 1, 3]])
    return out


def triangles(inside: tuple[bool, ...]) -> list[tuple[tuple[int, int], ...]]:
    """Triangles that part the inside corners of a positive tetrahedron from the others, each of three edges (pairs of
    corners), seen counterclockwise from outside."""
    n = sum(inside)
    for p in permutations(range(4)):
        if not _even(p):
            continue
        a, b, c, d = p
        if n in (1, 3) and inside[a] == (n == 1) and sum(inside[x] == inside[a] for x in p) == 1:
            one = ((a, b), (a, c), (a, d))
            return [one if n == 1 else one[::-1]]
        if n == 2 and inside[a] and inside[b]:
            return [((a, c), (a, d), (b, d)), ((a, c), (b, d), (b, c))]
    return []


def _names(base: np.ndarray, last: np.ndarray | int, width: int) -> np.ndarray:
    """One number for integer places and a small number."""
    if len(base) and (base.min() < -_half or base.max() >= _half):
        raise ValueError(f"a field may have {2 * _half} cells along an axis")
    b = (base + _half).astype(np.int64)
    return (((b[:, 0] << BITS | b[:, 1]) << BITS | b[:, 2]) << width) | last


def _brick(group: pa.Table, level: float) -> pa.Table:
    """The faces of one brick's cells; samples of the next bricks' first cells are with it."""
    place = np.stack([group.column(c).to_numpy() for c in "ijk"], 1)
    corner = np.array([group.column(f"b{c}")[0].as_py() for c in "ijk"]) * BRICK
    value = np.full((BRICK + 1,) * 3, np.nan)
    value[tuple((place - corner).T)] = group.column("value").to_numpy()
    inside = value < level
    shift = lambda a, o: a[o[0] : o[0] + BRICK, o[1] : o[1] + BRICK, o[2] : o[2] + BRICK]
    whole = np.ones((BRICK,) * 3, bool)
    for o in np.ndindex(2, 2, 2):
        whole &= ~np.isnan(shift(value, o))
    cut = [[] for _ in range(3)]
    for t, corners in enumerate(tetrahedra()):
        code = sum(shift(inside, o).astype(int) << n for n, o in enumerate(corners))
        for case in range(1, 15):
            cells = np.argwhere(whole & (code == case))
            if not len(cells):
                continue
            for s, edges in enumerate(triangles(tuple(bool(case >> n & 1) for n in range(4)))):
                names, points = [], []
                for a, b in edges:
                    low, high = sorted((tuple(corners[a]), tuple(corners[b])))  # one corner is below the other on every axis
                    base = cells + low
                    step = np.array(high) - low
                    u, v = value[tuple(base.T)], value[tuple((cells + high).T)]
                    names.append(_names(base + corner, int(step @ [4, 2, 1]), 3))
                    points.append(base + corner + ((level - u) / (v - u))[:, None] * step)
                cut[0].append(np.column_stack([_names(cells + corner, 2 * t + s, 4), cells + corner]))
                cut[1].append(np.column_stack(names))
                cut[2].append(np.hstack(points))
    ints = np.vstack(cut[0]) if cut[0] else np.zeros((0, 4), np.int64)
    names = np.vstack(cut[1]) if cut[1] else np.zeros((0, 3), np.int64)
    points = np.vstack(cut[2]) if cut[2] else np.zeros((0, 9))
    columns = [*ints.T, *names.T, *points.T]
    return pa.table({c.split()[0]: pa.array(x) for c, x in zip(FACE.split(", "), columns)})


def iso_faces(field: DataFrame, level: float = 0.0) -> DataFrame:
    """fid, i, j, k, v0, v1, v2 and corners x0 .. z2 (in cells) of the surface where a field (i, j, k: long, value) passes a level.

    Cells whose eight samples are all there are cut; inside is what lies below the level, and faces look outward. A
    brick of cells is a group, with the samples of its upper neighbours' first layer, so work is bounded by BRICK whatever
    the field. A vertex is named by the grid edge it lies on, so faces of neighbouring bricks share it by number. The surface is closed
    where no sample is missing around it, and every edge has two faces there. Nulls and NaN count as missing.
    """
    good = field.where("i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    at = {f"b{c}": F.floor(F.col(c) / BRICK) for c in "ijk"}
    own = good.select("i", "j", "k", F.col("value").cast("double").alias("value"), *[x.alias(n) for n, x in at.items()])
    for c in "ijk":  # a brick's first layer also belongs to the brick below
        first = F.pmod(F.col(c), F.lit(BRICK)) == 0
        own = own.withColumn(f"b{c}", F.explode(F.when(first, F.array(F.col(f"b{c}"), F.col(f"b{c}") - 1)).otherwise(F.array(f"b{c}"))))
    return own.groupBy("bi", "bj", "bk").applyInArrow(lambda t: _brick(t, level), FACE)


def iso_surface(field: DataFrame, level: float = 0.0, origin: tuple = (0.0, 0.0, 0.0), size: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """vertex (vid, x, y, z) and face (fid, v0, v1, v2) tables of that surface; sample (i, j, k) stands at origin + size (i, j, k)."""
    faces = iso_faces(field, level)
    ends = faces.select(F.explode(F.array(*[F.struct(F.col(f"v{n}").alias("vid"), *[F.col(f"{a}{n}").alias(a) for a in "xyz"]) for n in range(3)])).alias("v")).select("v.*")
    vertex = ends.groupBy("vid").agg(*[F.min(a).alias(a) for a in "xyz"])  # the same place from every face
    return vertex.select("vid", *[(F.col(a) * size + o).alias(a) for a, o in zip("xyz", origin)]), faces.select("fid", "v0", "v1", "v2")
