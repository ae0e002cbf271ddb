"""Sums over all points within a radius, without a row for each pair: tiles with what lies around them, counted in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a tile and its surroundings hold at most, as far as the densest cell tells, and tiles that there should be at least.
TILE_ROWS, LEAST_TILES = 1_000_000, 96
#: Pairs that are looked at together.
BLOCK = 400_000


def finite(axes) -> str:
    """SQL: a point has all its coordinates, and none is infinite (nothing is within a radius of such a point)."""
    return " AND ".join(f"{a} IS NOT NULL AND NOT isnan({a}) AND abs({a}) < double('infinity')" for a in axes)


def limit_of_squares(radius: float) -> float:
    """The largest double whose square root, rounded, is at most radius: sums of squares need no root to be compared as roots are."""
    top = np.float64(radius) * np.float64(radius)
    while np.sqrt(top) > radius:
        top = np.nextafter(top, 0)
    while np.sqrt(up := np.nextafter(top, np.inf)) <= radius:
        top = up
    return float(top)


def tiled(points: DataFrame, radius: float, axes: tuple[str, ...]) -> DataFrame:
    """points (with coordinates) in tiles _t0, _t1, ..: once in their own (_own), and once in each that they lie within radius of.

    A tile's side is one to four radii, less where points are dense, so that a tile stays small and there are enough of them."""
    cells = points.groupBy(*[F.floor(F.col(a) / radius) for a in axes]).count().agg(F.count("*"), F.max("count")).first()
    fits = [k for k in (4, 3, 2) if cells[0] >= LEAST_TILES * k ** len(axes) and (cells[1] or 0) * (k + 2) ** len(axes) <= TILE_ROWS]
    size, reach = radius * (fits[0] if fits else 1), radius * (1 + 1e-6)
    out, own = points, F.lit(True)
    for n, a in enumerate(axes):
        out = out.withColumn(f"_t{n}", F.explode(F.sequence(F.floor((F.col(a) - reach) / size), F.floor((F.col(a) + reach) / size))))
        own = own & (F.col(f"_t{n}") == F.floor(F.col(a) / size))
    return out.withColumn("_own", own)


def around(p: np.ndarray, own: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(i, j, near) for places p (n x axes): blocks of places i that own marks, the places j about them, and which of j lie within
    radius of which of i (None: all do). A place meets each of those about it once. Cells hold some dozens of places, or measure a quarter of the radius."""
    n, width = p.shape
    span = np.ptp(p, 0)
    side = max(radius / 4, float(np.prod(np.maximum(span, radius / 4)) * 32 / n) ** (1 / width))
    reach = int(np.ceil(radius * (1 + 1e-6) / side))
    cell = np.floor((p - p.min(0)) / side).astype(np.int64) + reach
    shape = cell.max(0) + reach + 1
    code = np.ravel_multi_index(tuple(cell.T), tuple(shape))
    order = np.lexsort((~own, code))
    p, own, code = p[order], own[order], code[order]
    cells, first = np.unique(code, return_index=True)
    last = np.append(first[1:], n)
    # neighbours along the last axis have following codes, so they are one slice
    steps = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * (width - 1), indexing="ij"), -1).reshape(-1, width - 1) if width > 1 else np.zeros((1, 0), np.int64)
    strides = np.append(np.cumprod(shape[:0:-1])[::-1], 1)
    offsets = steps @ strides[:-1]
    most = limit_of_squares(radius)
    have = np.add.reduceat(own, first)
    for c in np.flatnonzero(have):
        begin = np.searchsorted(code, cells[c] + offsets - reach)
        end = np.searchsorted(code, cells[c] + offsets + reach, "right")
        j = np.concatenate([np.arange(b, e) for b, e in zip(begin, end) if b < e])
        box = p[first[c] : last[c]]
        low, high = box.min(0), box.max(0)
        out, over = np.maximum(np.maximum(low - p[j], p[j] - high), 0), np.maximum(p[j] - low, high - p[j])
        within = (over * over).sum(1) <= most * (1 - 1e-9)
        some = ((out * out).sum(1) <= most * (1 + 1e-9)) & ~within
        sure, j = j[within], j[some]
        mine = np.arange(first[c], first[c] + have[c])
        for at in range(0, len(mine), k := max(1, BLOCK // max(len(sure), 1))) if len(sure) else ():
            yield order[mine[at : at + k]], order[sure], None
        q = p[j]
        for at in range(0, len(mine), k := max(1, BLOCK // max(len(j), 1))) if len(j) else ():
            i = mine[at : at + k]
            # term by term as Spark and SQL add them, so that points just at the radius fall alike
            total = np.zeros((len(i), len(j)))
            for a in range(width):
                d = p[i, a][:, None] - q[:, a]
                d *= d
                total += d
            yield order[i], order[j], total <= most


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows, how often each occurs, and the place of each row among them."""
    order = np.lexsort(rows.T[::-1])
    new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(1)) if len(rows) else np.zeros(0, bool)
    at = np.empty(len(rows), np.int64)
    at[order] = np.cumsum(new) - 1
    return rows[order[new]], np.bincount(at, minlength=int(new.sum())), at


def counts(points: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """id, n of points with coordinates: how many lie within radius, itself included. Points in the same place are counted together."""
    axes = tuple(axes)
    kind = dict(points.dtypes)["id"]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["_own"].to_numpy(bool)
        if not own.any():
            return pd.DataFrame({"id": pdf["id"][:0], "n": np.zeros(0, np.int64)})
        p, many, at = _distinct(pdf[list(axes)].to_numpy(float) + 0.0)
        asked = np.zeros(len(p), bool)
        asked[at[own]] = True
        n, real = np.zeros(len(p), np.int64), many.astype(float)
        for i, j, near in around(p, asked, radius):
            n[i] += many[j].sum() if near is None else np.rint(near @ real[j]).astype(np.int64)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[own], "n": n[at[own]]})

    tiles = tiled(points.where(finite(axes)).select("id", *[F.col(a).cast("double").alias(a) for a in axes]), radius, axes)
    return tiles.groupBy(*[f"_t{n}" for n in range(len(axes))]).applyInPandas(count, f"id {kind}, n long")


def agreement(points: DataFrame, radius: float, normals: tuple[str, ...] = ("nx", "ny", "nz"), axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """id, n, dot of points with coordinates and unit normals: how many others lie within radius, and the mean of the absolute
    products of their normals with its own (null without others)."""
    axes, normals = tuple(axes), tuple(normals)
    kind = dict(points.dtypes)["id"]

    def agree(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["_own"].to_numpy(bool)
        if not own.any():
            return pd.DataFrame({"id": pdf["id"][:0], "n": np.zeros(0, np.int64), "dot": np.zeros(0)})
        rows, many, at = _distinct(pdf[[*axes, *normals]].to_numpy(float) + 0.0)
        p, u, many = rows[:, : len(axes)].copy(), rows[:, len(axes) :].copy(), many.astype(float)
        asked = np.zeros(len(p), bool)
        asked[at[own]] = True
        n, total = np.zeros(len(p)), np.zeros(len(p))
        for i, j, near in around(p, asked, radius):
            dot = u[i] @ u[j].T
            np.abs(dot, out=dot)
            if near is not None:
                dot *= near
            n[i] += many[j].sum() if near is None else near @ many[j]
            total[i] += dot @ many[j]
        # not itself, but others in the same place
        n[asked] -= 1
        total[asked] -= (u * u).sum(1)[asked]
        n = np.rint(n).astype(np.int64)
        mean = np.divide(total, n, out=np.full(len(p), np.nan), where=n > 0)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[own], "n": n[at[own]], "dot": mean[at[own]]})

    tiles = tiled(points.where(finite(axes)).select("id", *[F.col(a).cast("double").alias(a) for a in (*axes, *normals)]), radius, axes)
    return tiles.groupBy(*[f"_t{n}" for n in range(len(axes))]).applyInPandas(agree, f"id {kind}, n long, dot double")
