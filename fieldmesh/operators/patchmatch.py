"""Slanted-window matching over tiles: planes of disparity spread between neighbours of a checkerboard and are refined at random."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmesh.operators.graph import dropped, settled

#: How far off neighbours are whose planes are tried; odd, so that they have the other colour.
STEPS = (1, 3)
REACH = max(STEPS)
SIDES = [(0, 1), (0, -1), (1, 1), (1, -1)]
ROWS = "bi long, bj long, side int, blob binary"
FOUND = "r long, c long, d double, a double, b double, cost double"


@dataclass(frozen=True)
class Search:
    """least, most: disparities of a pixel; slope: of a plane along rows and columns at most; radius of windows; truncated: cost of a
    pixel at most; tile: pixels along a tile's edge."""

    least: float
    most: float
    slope: float = 0.3
    radius: int = 3
    truncated: float = 40.0
    tile: int = 64

    @property
    def across(self) -> int:
        """Columns of the other image that a pixel may need on either side."""
        return math.ceil(max(abs(self.least), abs(self.most)) + 2 * self.slope * self.radius) + self.radius + 1


def noise(r: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that hang on a pixel's place and a salt alone, so tiles do not show."""
    with np.errstate(over="ignore"):
        x = r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt) * np.uint64(0x165667B19E3779F9)
        for shift in (33, 29, 32):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


class Tile:
    """Both images about a tile (nan where there is no pixel), and its pixels' planes (disparity, slopes) and costs."""

    def __init__(self, blob: bytes, at: tuple[int, int], s: Search):
        self.s, self.at, t = s, at, s.tile
        high, wide = t + 2 * s.radius, t + 2 * s.across
        x = np.frombuffer(blob, np.float64).copy()
        cut = np.cumsum([high * wide, high * wide, 3 * t * t])
        self.left, self.right = x[: cut[0]].reshape(high, wide), x[cut[0] : cut[1]].reshape(high, wide)
        self.plane, self.cost = x[cut[1] : cut[2]].reshape(3, t, t), x[cut[2] :].reshape(t, t)
        self.all = x
        self.around = np.full((3, t + 2 * REACH, t + 2 * REACH), np.nan)
        self.r, self.c = np.indices((t, t)) + np.array(at).reshape(2, 1, 1) * t
        self.there = ~np.isnan(self.left[s.radius : s.radius + t, s.across : s.across + t])

    @staticmethod
    def size(s: Search) -> int:
        return 2 * (s.tile + 2 * s.radius) * (s.tile + 2 * s.across) + 4 * s.tile**2

    def price(self, i: np.ndarray, j: np.ndarray, plane: np.ndarray) -> np.ndarray:
        """Mean truncated difference over the windows of pixels i, j under planes (3 x n); infinite beyond the disparities allowed."""
        s = self.s
        total = np.zeros(len(i))
        for di in range(-s.radius, s.radius + 1):
            row = i + s.radius + di
            for dj in range(-s.radius, s.radius + 1):
                col = j + s.across + dj
                back = plane[0] + plane[1] * dj + plane[2] * di
                whole = np.ceil(back)  # taken apart before the column comes in, so rounding does not hang on where a tile begins
                low = np.clip(col - whole.astype(int), 0, self.right.shape[1] - 2)
                w = whole - back
                other = self.right[row, low] * (1 - w) + self.right[row, low + 1] * w
                off = np.abs(self.left[row, col] - other)
                total += np.where(np.isnan(off), s.truncated, np.minimum(off, s.truncated))
        fits = (plane[0] >= s.least) & (plane[0] <= s.most) & (np.abs(plane[1:]) <= s.slope).all(0)
        return np.where(fits, total / (2 * s.radius + 1) ** 2, np.inf)

    def begin(self) -> None:
        s = self.s
        self.plane[0] = s.least + (s.most - s.least) * noise(self.r, self.c, 1)
        for k in (1, 2):
            self.plane[k] = s.slope * (2 * noise(self.r, self.c, 1 + k) - 1)
        i, j = np.nonzero(self.there)
        self.cost[:] = np.inf
        self.cost[i, j] = self.price(i, j, self.plane[:, i, j])

    def turn(self, n: int, refinements: int) -> None:
        """Half a sweep: pixels of one colour try the planes of neighbours, then random changes that halve."""
        s = self.s
        full = self.around.copy()
        full[:, REACH:-REACH, REACH:-REACH] = np.where(self.there, self.plane, np.nan)
        i, j = np.nonzero(self.there & ((self.r + self.c + n) % 2 == 0))
        best, cost = self.plane[:, i, j], self.cost[i, j]

        def offer(plane):
            price = np.where(np.isnan(plane).any(0), np.inf, self.price(i, j, np.nan_to_num(plane)))
            better = price < cost
            best[:, better], cost[better] = plane[:, better], price[better]

        for step in STEPS:
            for di, dj in ((0, step), (0, -step), (step, 0), (-step, 0)):
                p = full[:, i + REACH + di, j + REACH + dj]
                offer(np.stack([p[0] - p[1] * dj - p[2] * di, p[1], p[2]]))
        r, c = self.r[i, j], self.c[i, j]
        for k in range(refinements):
            share = 0.5**(k + 1 + n // 2)
            salt = 100 + 10 * (n * refinements + k)
            change = np.stack([(s.most - s.least) * (2 * noise(r, c, salt) - 1), s.slope * (2 * noise(r, c, salt + 1) - 1), s.slope * (2 * noise(r, c, salt + 2) - 1)])
            offer(best + share * change)
        self.plane[:, i, j], self.cost[i, j] = best, cost

    def strip(self, axis: int, step: int, inside: bool) -> tuple:
        """Index into the planes of a side's pixels, or into those around of what lies beyond it."""
        at = [slice(None), slice(REACH, -REACH), slice(REACH, -REACH)] if not inside else [slice(None)] * 3
        if inside:
            at[axis + 1] = slice(-REACH, None) if step > 0 else slice(0, REACH)
        else:
            at[axis + 1] = slice(-REACH, None) if step > 0 else slice(0, REACH)
        return tuple(at)


def _table(rows) -> pa.Table:
    return pa.table({n.split()[0]: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(ROWS.split(", "), (pa.int64(), pa.int64(), pa.int32(), pa.binary())))})


def _out(t: Tile) -> pa.Table:
    rows = [(*map(int, t.at), -1, t.all.tobytes())]
    for n, (axis, step) in enumerate(SIDES):
        to = list(map(int, t.at))
        to[axis] += step
        rows.append((*to, n ^ 1, np.where(t.there, t.plane, np.nan)[t.strip(axis, step, True)].tobytes()))
    return _table(rows)


def _begun(group: pa.Table, s: Search) -> pa.Table:
    at = tuple(group.column(c)[0].as_py() for c in ("bi", "bj"))
    t = Tile(np.full(Tile.size(s), np.nan).tobytes(), at, s)
    r, c = group.column("r").to_numpy() - at[0] * s.tile + s.radius, group.column("c").to_numpy() - at[1] * s.tile + s.across
    for image, name in ((t.left, "left"), (t.right, "right")):
        image[r, c] = group.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    t = Tile(t.all.tobytes(), at, s)
    if not t.there.any():
        return _table([])
    t.begin()
    return _out(t)


def _turned(group: pa.Table, s: Search, n: int, refinements: int) -> pa.Table:
    at = tuple(group.column(c)[0].as_py() for c in ("bi", "bj"))
    side, blob = group.column("side").to_pylist(), group.column("blob").to_pylist()
    if -1 not in side:
        return _table([])
    t = Tile(blob[side.index(-1)], at, s)
    for k, x in zip(side, blob):
        if k >= 0:
            where = t.strip(*SIDES[k], False)
            t.around[where] = np.frombuffer(x, np.float64).reshape(t.around[where].shape)
    t.turn(n, refinements)
    return _out(t)


def _half_sweep(s: Search, n: int, refinements: int):
    """One half sweep over a tile's rows; of one argument, as Spark gives a second one the key first."""
    return lambda group: _turned(group, s, n, refinements)


def slanted_disparities(pixels: DataFrame, search: Search, sweeps: int = 3, refinements: int = 4) -> DataFrame:
    """r, c, d, a, b, cost of every pixel (r, c, left, right: the values of both images there) with a left value: its disparity, by how much it grows
    a column and a row on, and the mean difference of its window. A left pixel c lies at c - d in the right image.

    Tiles carry both images with a border as wide as disparities reach, so each pixel goes to the few tiles that need it. After every half sweep
    tiles tell their neighbours the planes at their borders, and all is written. Random numbers hang on places, so results are the
    same whatever the tiles. Pixels with a null or nan are missing in that image.
    """
    s = search
    rows = pixels.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "left", "right")
    near = lambda c, by: F.explode(F.sequence(F.floor((F.col(c) - by) / s.tile), F.floor((F.col(c) + by) / s.tile)))
    dealt = rows.withColumn("bi", near("r", s.radius)).withColumn("bj", near("c", s.across))
    state = settled(dealt.groupBy("bi", "bj").applyInArrow(lambda g: _begun(g, s), ROWS))
    for n in range(2 * sweeps):
        before, state = state, settled(state.groupBy("bi", "bj").applyInArrow(_half_sweep(s, n, refinements), ROWS))
        dropped(state.sparkSession, before)

    def planes(batches):
        for b in batches:
            for bi, bj, blob in zip(*(b.column(c).to_pylist() for c in ("bi", "bj", "blob"))):
                t = Tile(blob, (bi, bj), s)
                i, j = np.nonzero(t.there)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t.r[i, j], t.c[i, j], *t.plane[:, i, j], t.cost[i, j])], ["r", "c", "d", "a", "b", "cost"])

    return state.where("side = -1").mapInArrow(planes, FOUND)
