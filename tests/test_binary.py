"""Binary files: round trips, descriptors passed over, cut files, and writes that fail."""

import os
import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmesh.sources import binary


def test_points_round_trip(spark):
    path = tempfile.mkdtemp()
    rows = [(f"{k}.match", n, float(n), n / 4, n + 0.5, -float(n)) for k in range(3) for n in range(4 + k)] + [("3.match", 0, float("nan"), 0.0, 0.0, 0.0), ("3.match", 1, 3.0, 1e12, 0.0, 0.0), ("3.match", 2, 1.0, 2.0, 3.0, 4.0)]
    binary.write_points(spark.createDataFrame(rows, "name string, n long, xa double, ya double, xb double, yb double").repartition(3), path)
    assert sorted(os.listdir(path)) == [f"{k}.match" for k in range(4)]
    got = [tuple(r) for r in binary.read_points(spark, path).collect()]
    assert sorted(got) == sorted(r for r in rows if r[0] != "3.match" or r[1] == 2)


def test_descriptors_and_uneven_sides():
    left = b"".join(struct.pack("<ffiifffbIIQ", k, k + 0.5, 0, 0, 0, 0, 0, 0, 0, 0, k) + b"\1\2\3\4" * k for k in range(3))
    right = struct.pack("<ffiifffbIIQ", 7, 8, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    content = struct.pack("<QQ", 3, 1) + left + right
    a, b = binary.decode_points(content)
    assert a.tolist() == [[0, 0.5], [1, 1.5], [2, 2.5]] and b.tolist() == [[7, 8]]
    for cut in (3, 20, len(content) - 1, len(content) - len(right) - 2):
        with pytest.raises(binary.CutFile):
            binary.decode_points(content[:cut])
    with pytest.raises(binary.CutFile):
        binary.decode_points(struct.pack("<QQ", 1 << 60, 0))


def test_rasters_round_trip(spark):
    path = tempfile.mkdtemp()
    rows = [(r, c, (r * 7 + c) / 8) for r in range(-5, 40) for c in range(-3, 50) if (r + c) % 5]
    binary.write_geotiffs(spark.createDataFrame([*rows, (1000, 1000, 5.0), (2, 3, None)], "r long, c long, value double"), path, 0.5, (100.0, 200.0), block=32)
    assert len(os.listdir(path)) == 9 + 1 and "r31_c31.tif" in os.listdir(path)
    assert sorted(tuple(r) for r in binary.read_geotiffs(spark, path, (100.0, 200.0)).collect()) == sorted([*rows, (1000, 1000, 5.0)])
    content = open(f"{path}/r0_c0.tif", "rb").read()
    z, x, y, step, nodata = binary.decode_geotiff(content)
    assert (z.shape, x, y, step, nodata) == ((32, 32), 100.0, 200.0, 0.5, -9999.0)
    for cut in (4, 3000, len(content) - 200):
        with pytest.raises(binary.CutFile):
            binary.decode_geotiff(content[:cut])


def test_uneven_raster():
    z = np.arange(70 * 130, dtype=np.float32).reshape(70, 130)
    assert (binary.decode_geotiff(binary.encode_geotiff(z, 1.0, 2.0, 3.0, -1.0))[0] == z).all()


def test_a_failed_write_leaves_nothing(spark):
    path = tempfile.mkdtemp()
    rows = spark.range(20).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("stop"))).otherwise(F.lit(b"x")).cast("binary").alias("content")).repartition(4)
    with pytest.raises(Exception, match="stop"):
        binary.write_files(rows, path)
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="one name"):
        binary.write_files(spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary"), path)
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="slash"):
        binary.write_files(spark.createDataFrame([("a/b", b"1")], "name string, content binary"), path)
