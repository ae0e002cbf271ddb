"""Camera poses from points whose places are known: three-point poses over groups, the one that most points agree with, refined."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORLD, PIXEL = ["x", "y", "z"], ["u", "v"]


def three_point_poses(world: np.ndarray, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poses (rotation world to camera, shift) that see three points (sets x 3 x 3) along three unit rays. A quartic gives up to four
    for each set; imaginary ones and those with a point behind the camera are left out."""
    side = [np.linalg.norm(world[:, i] - world[:, j], axis=1) for i, j in ((1, 2), (0, 2), (0, 1))]
    ca, cb, cg = (np.einsum("ni,ni->n", rays[:, i], rays[:, j]) for i, j in ((1, 2), (0, 2), (0, 1)))
    with np.errstate(all="ignore"):
        a, b, c = (s * s for s in side)
        p, q, r = (a - c) / b, (a + c) / b, c / b
        s = a / b
        quartic = np.stack([
            (p - 1) ** 2 - 4 * r * ca**2,
            4 * (p * (1 - p) * cb - (1 - q) * ca * cg + 2 * r * ca**2 * cb),
            2 * (p**2 - 1 + 2 * p**2 * cb**2 + 2 * (1 - r) * ca**2 - 4 * q * ca * cb * cg + 2 * (1 - s) * cg**2),
            4 * (-p * (1 + p) * cb + 2 * s * cg**2 * cb - (1 - q) * ca * cg),
            (1 + p) ** 2 - 4 * s * cg**2,
        ], 1)
        monic = quartic[:, 1:] / quartic[:, :1]
        ok = np.isfinite(monic).all(1)
        companion = np.zeros((ok.sum(), 4, 4))
        companion[:, 0] = -monic[ok]
        companion[:, [1, 2, 3], [0, 1, 2]] = 1
        roots = np.linalg.eigvals(companion)
        of = np.repeat(np.flatnonzero(ok), 4)
        v = roots.ravel()
        real = np.abs(v.imag) < 1e-6 * np.maximum(1, np.abs(v.real))
        of, v = of[real], v.real[real]
        for _ in range(2):  # roots of near pairs are poor; Newton's steps mend them
            k = quartic[of]
            f = (((k[:, 0] * v + k[:, 1]) * v + k[:, 2]) * v + k[:, 3]) * v + k[:, 4]
            g = ((4 * k[:, 0] * v + 3 * k[:, 1]) * v + 2 * k[:, 2]) * v + k[:, 3]
            v = np.where(np.abs(g) > 1e-12, v - f / g, v)
        u = ((p[of] - 1) * v**2 - 2 * p[of] * cb[of] * v + 1 + p[of]) / (2 * (cg[of] - v * ca[of]))
        first = np.sqrt(b[of] / (1 + v**2 - 2 * v * cb[of]))
        depth = np.stack([first, u * first, v * first], 1)
        good = np.isfinite(depth).all(1) & (depth > 0).all(1)
    of, depth = of[good], depth[good]
    seen = depth[:, :, None] * rays[of]

    def frame(t):
        x = t[:, 1] - t[:, 0]
        z = np.cross(x, t[:, 2] - t[:, 0])
        x, z = (w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300) for w in (x, z))
        return np.stack([x, np.cross(z, x), z], 2)

    rotation = frame(seen) @ frame(world[of]).transpose(0, 2, 1)
    return rotation, seen[:, 0] - np.einsum("nij,nj->ni", rotation, world[of][:, 0])


def offsets(rotation: np.ndarray, shift: np.ndarray, world: np.ndarray, plane: np.ndarray, portion: int = 4096):
    """For portions of the points, how far each pose's projections are off (poses x points), in units of the image plane at one; infinite behind the camera."""
    for i in range(0, len(world), portion):
        at = world[i : i + portion] @ rotation.transpose(0, 2, 1) + shift[:, None]
        with np.errstate(all="ignore"):
            off = np.linalg.norm(at[..., :2] / at[..., 2:] - plane[i : i + portion], axis=2)
        yield np.where((at[..., 2] > 0) & np.isfinite(off), off, np.inf)


def refined(rotation: np.ndarray, shift: np.ndarray, world: np.ndarray, plane: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Newton on the projections of all points given."""
    for _ in range(steps):
        at = world @ rotation.T + shift
        x, y, z = at.T
        d = np.zeros((len(at), 2, 3))
        d[:, 0, 0] = d[:, 1, 1] = 1 / z
        d[:, 0, 2], d[:, 1, 2] = -x / z**2, -y / z**2
        turned = at - shift
        skew = np.zeros((len(at), 3, 3))
        for i, j, k, sign in ((0, 1, 2, 1), (0, 2, 1, -1), (1, 0, 2, -1), (1, 2, 0, 1), (2, 0, 1, 1), (2, 1, 0, -1)):
            skew[:, i, j] = sign * turned[:, k]
        jac = np.concatenate([d @ skew, d], 2).reshape(-1, 6)
        left = (at[:, :2] / at[:, 2:] - plane).ravel()
        move = np.linalg.lstsq(jac, -left, rcond=None)[0]
        angle = np.linalg.norm(move[:3])
        if angle > 0:
            k = move[:3] / angle
            c = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
            rotation = (np.eye(3) + np.sin(angle) * c + (1 - np.cos(angle)) * c @ c) @ rotation
        shift = shift + move[3:]
        if np.abs(move).max() < 1e-12:
            break
    return rotation, shift


def robust_pose(world: np.ndarray, plane: np.ndarray, threshold: float, confidence: float, trials: int, seed: int, batch: int = 64):
    """Rotation, shift, inliers of the pose that most points agree with; None without one."""
    n = len(world)
    if n < 4:
        return None
    rays = np.concatenate([plane, np.ones((n, 1))], 1)
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    rng, best, most, done, wanted = np.random.default_rng(seed), None, 3, 0, trials
    agree = lambda r, t: np.concatenate([o <= threshold for o in offsets(r[None], t[None], world, plane)], 1)[0]
    while done < min(trials, wanted):
        pick = np.stack([rng.choice(n, 3, replace=False) for _ in range(batch)])
        done += batch
        r, t = three_point_poses(world[pick], rays[pick])
        if not len(r):
            continue
        count = sum((o <= threshold).sum(1) for o in offsets(r, t, world, plane))
        if count.max() > most:
            best = r[count.argmax()], t[count.argmax()]
            most = int(count.max())
            for _ in range(5):
                some = agree(*best)
                again = refined(*best, world[some], plane[some])
                more = int(agree(*again).sum())
                if more < most:
                    break
                best, settled = again, more == most
                most = more
                if settled:
                    break
            miss = 1 - (most / n) ** 3
            wanted = 0 if miss <= 0 else np.log(1 - confidence) / np.log(miss)
    return None if best is None else (*best, most)


def poses(points: DataFrame, keys: list[str], focal: tuple[float, float], middle: tuple[float, float], threshold: float = 4.0, confidence: float = 0.999, trials: int = 1000, least: int = 10, least_share: float = 0.25, few: int = 20, few_share: float = 0.8, seed: int = 0) -> DataFrame:
    """keys, rotation (camera to world, nine numbers by rows), centre (three), points, inliers, passed of cameras that see
    known points (keys, x, y, z, u, v). A pose needs `least` inliers and a share of least_share, of few_share where it has
    fewer than `few` points; without any pose rotation and centre are null.

    Points with a null or infinite number do not count, equal ones count once. A group is one image, so an image's features bound it; hypotheses
    are scored in portions of its points.
    """
    types = dict(points.dtypes)
    fu, fv = focal

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(pdf[WORLD + PIXEL].to_numpy(float), axis=0)  # the same whatever order the rows arrive in
        p = p[np.isfinite(p).all(1)]
        world, plane = p[:, :3], (p[:, 3:] - middle) / (fu, fv)
        found = robust_pose(world, plane, threshold / np.sqrt(fu * fv), confidence, trials, seed)
        n, inliers = len(p), found[2] if found else 0
        passed = bool(inliers >= least and inliers >= n * (few_share if n < few else least_share))
        rotation, centre = (found[0].T.ravel().tolist(), (-found[0].T @ found[1]).tolist()) if found else (None, None)
        return pd.DataFrame({**{c: [v] for c, v in zip(keys, key)}, "rotation": [rotation], "centre": [centre], "points": [n], "inliers": [inliers], "passed": [passed]})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", rotation array<double>, centre array<double>, points long, inliers long, passed boolean"
    return points.select(*keys, *WORLD, *PIXEL).groupBy(*keys).applyInPandas(fit, schema)


def reprojection(focal: tuple[float, float], middle: tuple[float, float]) -> Column:
    """Pixels between (u, v) and where a pose (rotation, centre) projects (x, y, z); null behind the camera or without a pose."""
    off = [F.col(c) - F.get("centre", F.lit(n)) for n, c in enumerate(WORLD)]
    seen = [sum((F.get("rotation", F.lit(3 * n + k)) * off[n] for n in (1, 2)), F.get("rotation", F.lit(k)) * off[0]) for k in range(3)]
    u, v = (f * s / seen[2] + m for f, s, m in zip(focal, seen, middle))
    return F.when(seen[2] > 0, F.hypot(u - F.col("u"), v - F.col("v")))
