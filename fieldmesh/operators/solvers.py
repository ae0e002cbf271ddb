"""Estimators: small kernels for each group run as Arrow-fed pandas functions, moments come from distributed sums."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmesh.functions.order_stats import median


def similarity_fit(pairs: DataFrame) -> dict:
    """Scale, rotation and translation that take (x, y, z) to (u, v, w) with least squares. Sums are distributed; the
    3 x 3 decomposition of one row is done here."""
    src, dst = ("x", "y", "z"), ("u", "v", "w")
    r = pairs.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in src + dst], *[F.covar_pop(a, b).alias(a + b) for a in src for b in dst], sum((F.var_pop(c) for c in src[1:]), F.var_pop(src[0])).alias("var")).first()
    if not r["n"] or not r["var"]:
        return {"scale": 1.0, "rotation": np.eye(3).tolist(), "translation": [0.0] * 3}
    cov = np.array([[r[a + b] for a in src] for b in dst])
    u, s, vt = np.linalg.svd(cov)
    d = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1])
    rot = u @ d @ vt
    scale = float((s * np.diag(d)).sum() / r["var"])
    t = np.array([r[c] for c in dst]) - scale * rot @ np.array([r[c] for c in src])
    return {"scale": scale, "rotation": rot.tolist(), "translation": t.tolist()}


def median_shift(pairs: DataFrame) -> tuple[float, ...]:
    """The median of target - source on each axis."""
    r = pairs.agg(*[median(F.col(b) - F.col(a)).alias(a) for a, b in (("x", "u"), ("y", "v"), ("z", "w"))]).first()
    return tuple(r)


def line_ransac(df: DataFrame, keys: list[str], tolerance: float, trials: int = 64, seed: int = 7, most: int = 100_000) -> DataFrame:
    """keys, slope, offset, inliers, n of the line y = slope x + offset most points of a group agree with. A group's points are
    one pair's matches (at most a few thousand); a larger group is an error, not a sample."""
    types = dict(df.dtypes)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError("a pair has more matches than a group may hold")
        pdf = pdf.dropna(subset=["x", "y"]).sort_values(["x", "y"])
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        best = (0, 0.0, 0.0)
        rng = np.random.default_rng(seed)
        for _ in range(trials if len(x) > 1 else 0):
            i, j = rng.choice(len(x), 2, replace=False)
            if x[i] == x[j]:
                continue
            m = (y[j] - y[i]) / (x[j] - x[i])
            b = y[i] - m * x[i]
            n = int((np.abs(y - m * x - b) <= tolerance).sum())
            if n > best[0]:
                best = (n, m, b)
        return pd.DataFrame([[*key, best[1], best[2], best[0], len(x)]], columns=[*keys, "slope", "offset", "inliers", "n"])

    return df.groupBy(*keys).applyInPandas(fit, ", ".join([f"{k} {types[k]}" for k in keys]) + ", slope double, offset double, inliers long, n long")


def _kept(p: np.ndarray, radius: float) -> np.ndarray:
    """Which places, in order, stay if none that stays before them is nearer than radius. What stays is kept by cells of that size, so a
    place is held against few others however many there are."""
    cells: dict[tuple, list[int]] = {}
    steps = list(product((-1, 0, 1), repeat=p.shape[1]))
    # a cell as wide as the radius and a little more, lest rounding puts two near ones two cells apart
    home = np.floor(p / (radius * (1 + 1e-9)))
    stay = np.zeros(len(p), bool)
    for i, at in enumerate(map(tuple, home.tolist())):
        near = [k for s in steps for k in cells.get(tuple(a + b for a, b in zip(at, s)), ())]
        if not near or not (((p[near] - p[i]) ** 2).sum(1) < radius * radius).any():
            stay[i] = True
            cells.setdefault(at, []).append(i)
    return stay


def greedy_by_distance(df: DataFrame, block: str, radius: float) -> DataFrame:
    """Within a block, points in order of rank (desc) and id stay if no point that stays is nearer than radius (points without a
    coordinate stay, and stop none). The greedy order is the contract, so a block is one group, as large as it may be."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], ascending=[False, True])
        p = pdf[["x", "y", "z"]].to_numpy(float)
        known = np.isfinite(p).all(1)
        # of points in one place only the first can stay
        first = ~pd.DataFrame(p).duplicated().to_numpy() if radius > 0 else known
        stay = ~known
        asked = np.flatnonzero(known & first)
        stay[asked] = _kept(p[asked], radius) if radius > 0 else True
        return pdf[stay]

    return df.groupBy(block).applyInPandas(pick, df.schema)


def balanced_tracks(obs: DataFrame, limit: int) -> DataFrame:
    """image, track kept: cells of an image take turns, each its longest track first (ties by track), until limit are taken.
    A cell's tracks beyond the limit can't be taken, so they are left out before the turns are ordered."""
    turn = F.row_number().over(Window.partitionBy("image", "cell").orderBy(F.desc("length"), "track"))
    some = obs.withColumn("turn", turn).where(F.col("turn") <= limit)
    place = F.row_number().over(Window.partitionBy("image").orderBy("turn", "cell"))
    return some.withColumn("place", place).where(F.col("place") <= limit).select("image", "track")


def triangulated(obs: DataFrame) -> DataFrame:
    """track, x, y, z, views: the point nearest to the rays (ox, oy, oz) + s (dx, dy, dz) of each track, from sums alone."""
    d = [F.col(f"d{a}") for a in "xyz"]
    o = [F.col(f"o{a}") for a in "xyz"]
    norm = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    u = [c / norm for c in d]
    m = {(i, j): (F.lit(1.0 if i == j else 0.0) - u[i] * u[j]) for i in range(3) for j in range(3)}
    sums = [F.sum(m[i, j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)] + [F.sum(sum((m[i, j] * o[j] for j in (1, 2)), m[i, 0] * o[0])).alias(f"b{i}") for i in range(3)]
    s = obs.groupBy("track").agg(F.count("*").alias("views"), *sums)
    a = {(i, j): F.col(f"m{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    b = [F.col(f"b{i}") for i in range(3)]

    def det(c) -> object:
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    base = [[a[i, j] for j in range(3)] for i in range(3)]
    whole = det(base)
    solved = [det([[b[i] if j == k else base[i][j] for j in range(3)] for i in range(3)]) / whole for k in range(3)]
    return s.where((F.col("views") >= 2) & (F.abs(whole) > 1e-12)).select("track", *[c.alias(n) for c, n in zip(solved, "xyz")], "views")


def control_fit(pairs: DataFrame, limit: float, rounds: int = 4) -> tuple[dict, DataFrame]:
    """A similarity fitted to control points (id, x, y, z, u, v, w), again without points farther off than limit until none is
    dropped. The fit and the points with residual and used."""
    from fieldmesh.functions import scalars

    used, seen = pairs, None
    fit: dict = {}
    scored = pairs
    for _ in range(rounds):
        fit = similarity_fit(used)
        flat = [v for row in fit["rotation"] for v in row]
        p = scalars.similarity(F.col("x"), F.col("y"), F.col("z"), fit["scale"], flat, fit["translation"])
        off = F.sqrt(sum(((a - F.col(b)) ** 2 for a, b in zip(p[1:], ("v", "w"))), (p[0] - F.col("u")) ** 2))
        scored = pairs.withColumn("residual", off).withColumn("used", F.col("residual") <= limit)
        used = scored.where("used").select(*pairs.columns)
        n = used.count()
        if n == seen or n < 3:
            break
        seen = n
    return fit, scored
