"""Poses from known points: planted cameras, with outliers, few points, and odd groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmesh.operators import pose

SCHEMA = "camera long, x double, y double, z double, u double, v double"
FOCAL, MIDDLE = (900.0, 950.0), (500.0, 400.0)


def turn(axis, angle):
    k = np.array(axis) / np.linalg.norm(axis)
    c = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * c + (1 - np.cos(angle)) * c @ c


def seen(rng, n, rotation, centre, noise=0.0, wrong=0.0):
    world = centre + rng.uniform((-5, -4, 8), (5, 4, 20), (n, 3)) @ rotation.T
    at = (world - centre) @ rotation
    uv = at[:, :2] / at[:, 2:] * FOCAL + MIDDLE + rng.normal(0, noise, (n, 2)) * (noise > 0)
    bad = rng.random(n) < wrong
    uv[bad] += rng.choice([-1, 1], (bad.sum(), 2)) * rng.uniform(30, 300, (bad.sum(), 2))
    return np.column_stack([world, uv]), ~bad


def test_three_points_give_their_pose():
    rng = np.random.default_rng(0)
    rotation, centre = turn((1, 2, 3), 0.8), np.array([3.0, -2, 1])
    p, _ = seen(rng, 300, rotation, centre)
    rays = np.column_stack([(p[:, 3:] - MIDDLE) / FOCAL, np.ones(300)])
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    r, t = pose.three_point_poses(p[:, :3].reshape(100, 3, 3), rays.reshape(100, 3, 3))
    close = (np.abs(r - rotation.T).max((1, 2)) < 1e-6) & (np.abs(t + rotation.T @ centre).max(1) < 1e-5)
    assert close.sum() >= 95


def test_planted_poses_with_outliers(spark):
    rng = np.random.default_rng(1)
    rows, planted = [], {}
    for camera, (n, noise, wrong) in enumerate([(200, 0.0, 0.0), (400, 0.5, 0.4), (300, 0.3, 0.6), (15, 0.2, 0.0)]):
        rotation, centre = turn(rng.normal(size=3), rng.uniform(0, 3)), rng.uniform(-9, 9, 3)
        p, good = seen(rng, n, rotation, centre, noise, wrong)
        planted[camera] = rotation, centre, good.sum()
        rows += [(camera, *map(float, x)) for x in p]
    rows += [(7, *map(float, x)) for x in rng.uniform(0, 500, (12, 5))] + [(8, 1.0, 2.0, 3.0, 4.0, 5.0), (8, None, 2.0, 3.0, 4.0, 5.0), (9, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = pose.poses(df, ["camera"], FOCAL, MIDDLE)
    got = {r["camera"]: r for r in found.collect()}
    for camera, (rotation, centre, good) in planted.items():
        r = got[camera]
        assert r["passed"] and abs(r["inliers"] - good) <= 0.02 * good
        assert np.abs(np.reshape(r["rotation"], (3, 3)) - rotation).max() < 5e-3 and np.abs(np.array(r["centre"]) - centre).max() < 0.08
    assert not any(got[c]["passed"] for c in (7, 8, 9)) and got[8]["points"] == 1 and got[9]["rotation"] is None
    off = df.join(found, "camera").where("camera = 0").select(F.max(pose.reprojection(FOCAL, MIDDLE))).first()[0]
    assert off == pytest.approx(0, abs=1e-6)
