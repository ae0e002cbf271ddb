"""Two-view geometry of image pairs: a robust homography or fundamental matrix for each pair, residuals of its matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches that a model needs.
MINIMAL = {"homography": 4, "fundamental": 8}
POINTS = ["xa", "ya", "xb", "yb"]


def centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of points (sets x n x 2) moved to their mean and scaled to a mean length of sqrt 2, and the 3 x 3 matrices that do it."""
    mean = p.mean(1, keepdims=True)
    scale = np.sqrt(2) / np.maximum(np.linalg.norm(p - mean, axis=2).mean(1), 1e-12)
    t = np.zeros((len(p), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = scale
    t[:, :2, 2] = -scale[:, None] * mean[:, 0]
    t[:, 2, 2] = 1
    return (p - mean) * scale[:, None, None], t


def estimated(a: np.ndarray, b: np.ndarray, model: str) -> np.ndarray:
    """Least-squares models (sets x 3 x 3, of unit norm) of sets of matches a to b."""
    (p, ta), (q, tb) = centred(a), centred(b)
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    one, none = np.ones_like(x), np.zeros_like(x)
    if model == "homography":
        rows = np.concatenate([np.stack([x, y, one, none, none, none, -u * x, -u * y, -u], 2), np.stack([none, none, none, x, y, one, -v * x, -v * y, -v], 2)], 1)
    else:
        rows = np.stack([u * x, u * y, u, v * x, v * y, v, x, y, one], 2)
    m = np.linalg.eigh(rows.transpose(0, 2, 1) @ rows)[1][:, :, 0].reshape(-1, 3, 3)
    if model == "fundamental":  # of rank two
        left, s, right = np.linalg.svd(m)
        s[:, 2] = 0
        m = left @ (s[:, :, None] * right)
        m = tb.transpose(0, 2, 1) @ m @ ta
    else:
        m = np.linalg.inv(tb) @ m @ ta
    return m / np.maximum(np.linalg.norm(m, axis=(1, 2), keepdims=True), 1e-300)


def residuals_of(m: np.ndarray, a: np.ndarray, b: np.ndarray, model: str) -> np.ndarray:
    """models x matches: pixels off, or Sampson's distance; infinite where it is not defined."""
    h = np.concatenate([a, np.ones((len(a), 1))], 1) @ m.transpose(0, 2, 1)
    with np.errstate(all="ignore"):
        if model == "homography":
            r = np.hypot(h[..., 0] / h[..., 2] - b[:, 0], h[..., 1] / h[..., 2] - b[:, 1])
        else:
            g = np.concatenate([b, np.ones((len(b), 1))], 1)
            back = g @ m
            r = np.abs((h * g).sum(2)) / np.sqrt(h[..., 0] ** 2 + h[..., 1] ** 2 + back[..., 0] ** 2 + back[..., 1] ** 2)
    return np.where(np.isfinite(r), r, np.inf)


def agreeing(m: np.ndarray, a: np.ndarray, b: np.ndarray, model: str, threshold: float, portion: int = 8192) -> np.ndarray:
    """How many matches agree with each model; matches are walked in portions."""
    return sum((residuals_of(m, a[i : i + portion], b[i : i + portion], model) <= threshold).sum(1) for i in range(0, len(a), portion))


def robust(a: np.ndarray, b: np.ndarray, model: str, threshold: float, confidence: float, trials: int, seed: int, batch: int = 64) -> np.ndarray | None:
    """The model that most matches agree with, fitted again to those; None without one."""
    n, k = len(a), MINIMAL[model]
    if n < k:
        return None
    rng, best, most, done, wanted = np.random.default_rng(seed), None, 0, 0, trials
    while done < min(trials, wanted):
        pick = np.stack([rng.choice(n, k, replace=False) for _ in range(batch)])
        m = estimated(a[pick], b[pick], model)
        count = agreeing(m, a, b, model, threshold)
        done += batch
        if count.max() > most:
            best, most = m[count.argmax()], int(count.max())
            for _ in range(5):  # its inliers give a better model, as long as more agree
                some = residuals_of(best[None], a, b, model)[0] <= threshold
                again = estimated(a[some][None], b[some][None], model) if some.sum() >= k else best[None]
                more = int(agreeing(again, a, b, model, threshold)[0])
                if more < most or (again[0] == best).all():
                    break
                best, most = again[0], more
            miss = 1 - (most / n) ** k
            wanted = 0 if miss <= 0 else np.log(1 - confidence) / np.log(miss) if miss < 1 else trials
    return best if most >= k else None


def models(matches: DataFrame, keys: list[str], model: str = "fundamental", threshold: float = 1.5, confidence: float = 0.9999, trials: int = 10_000, seed: int = 0, most: int = 500_000) -> DataFrame:
    """keys, matrix (nine numbers by rows, of unit norm; null without a model) of each pair's matches (keys, xa, ya, xb, yb).

    Matches with a null, NaN or infinite place do not count. A group is one pair of images, so it is bounded by an
    image's features; a larger one than most is an error, not a sample.
    """
    types = dict(matches.dtypes)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError("a pair has more matches than a group may hold")
        p = np.unique(pdf[POINTS].to_numpy(float), axis=0)  # the same whatever order the rows arrive in
        p = p[np.isfinite(p).all(1)]
        m = robust(p[:, :2], p[:, 2:], model, threshold, confidence, trials, seed)
        return pd.DataFrame({**{c: [v] for c, v in zip(keys, key)}, "matrix": [None if m is None else m.ravel().tolist()]})

    return matches.select(*keys, *POINTS).groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {types[k]}" for k in keys) + ", matrix array<double>")


def residual(model: str) -> Column:
    """A match's residual under matrix; null where it is not defined."""
    m = [F.get("matrix", F.lit(k)) for k in range(9)]
    xa, ya, xb, yb = (F.col(c).cast("double") for c in POINTS)
    hx, hy, hz = (m[k] * xa + m[k + 1] * ya + m[k + 2] for k in (0, 3, 6))
    if model == "homography":
        out = F.when(F.abs(hz) > 1e-15, F.hypot(hx / hz - xb, hy / hz - yb))
    else:
        bx, by = m[0] * xb + m[3] * yb + m[6], m[1] * xb + m[4] * yb + m[7]
        low = hx * hx + hy * hy + bx * bx + by * by
        out = F.when(low > 1e-15, F.abs(xb * hx + yb * hy + hz) / F.sqrt(low))
    return F.when(F.abs(out) < float("inf"), out)


def verified(matches: DataFrame, keys: list[str], model: str = "fundamental", threshold: float = 1.5, **how) -> DataFrame:
    """matches with residual (null without a model) and inlier."""
    found = models(matches, keys, model, threshold, **how)
    out = matches.join(found, keys, "left").withColumn("residual", residual(model)).drop("matrix")
    return out.withColumn("inlier", F.coalesce(F.col("residual") <= threshold, F.lit(False)))


def gated(matches: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """keys, valid, inliers, passed of verified matches: a pair passes with enough inliers."""
    real = F.lit(True)
    for c in POINTS:
        real = real & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    t = matches.groupBy(*keys).agg(F.count_if(real).alias("valid"), F.count_if("inlier").alias("inliers"))
    return t.withColumn("passed", F.col("inliers") >= max(0, least))
