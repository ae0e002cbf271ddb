"""Level surfaces: closed and manifold whatever the field; triangles found by cells against all of them; radial products."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmesh.operators import mesh, surface, triangles
from fieldmesh.plans import catalog, catalog_surface  # noqa: F401  registers the query
from tests_shapes import field


def test_all_configurations_are_closed_and_manifold(spark):
    """Each of the 255 sign patterns of a cell, enclosed by outside samples, all in one field."""
    rows = []
    for c in range(256):
        inside = {tuple(1 + (n >> a & 1) for a in range(3)) for n in range(8) if c >> n & 1}
        rows += [(i + 4 * (c % 16) - 20, j + 4 * (c // 16), k - 1, -1.0 if (i, j, k) in inside else 1.0) for i in range(4) for j in range(4) for k in range(4)]
    vertex, face = surface.iso_surface(spark.createDataFrame(rows, "i long, j long, k long, value double"))
    one = mesh.topology(vertex, face).first()
    assert one["boundary"] == 0 and one["non_manifold"] == 0 and one["vertices"] == vertex.count() > 0


@pytest.mark.parametrize("name,f,euler", [
    ("sphere over bricks", lambda x, y, z: np.sqrt((x - 19) ** 2 + (y - 18) ** 2 + (z - 17.5) ** 2) - 14.2, 2),
    ("ring", lambda x, y, z: np.sqrt((np.sqrt((x - 18) ** 2 + (y - 18) ** 2) - 10) ** 2 + (z - 18) ** 2) - 4.3, 0),
    ("two plates", lambda x, y, z: np.minimum(*(np.max([abs(x - 18) - 12, abs(y - 18) - 10, abs(z - c) - 2.5], 0) for c in (10, 24))), 4),
])
def test_closed_shapes(spark, name, f, euler):
    vertex, face = surface.iso_surface(field(spark, f, 37), 0.0, (1.0, 2.0, 3.0), 0.5)
    one = mesh.topology(vertex, face).first()
    assert (one["boundary"], one["non_manifold"], one["euler"]) == (0, 0, euler)
    # faces look outward: the volume by signed tetrahedra is that of the shape
    at = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in vertex.collect()}
    volume = sum(np.dot(at[r["v0"]], np.cross(at[r["v1"]], at[r["v2"]])) / 6 for r in face.collect())
    g = np.indices((37, 37, 37)).astype(float)
    assert volume == pytest.approx((f(*g.reshape(3, -1)) < 0).sum() * 0.125, rel=0.1)
    assert face.select("fid").distinct().count() == one["faces"]


def test_missing_samples_leave_borders(spark):
    f = field(spark, lambda x, y, z: z - 2.5, 6)
    assert mesh.topology(*surface.iso_surface(f)).first()["boundary"] == 40
    holes = f.withColumn("value", F.when(F.col("i") != 3, F.col("value"))).union(spark.createDataFrame([(None, 1, 1, 0.0), (9, 9, 9, float("nan"))], f.schema))
    one = mesh.topology(*surface.iso_surface(holes)).first()
    assert (one["faces"], one["euler"]) == (3 * 5 * 8, 2)
    assert surface.iso_surface(f.limit(0))[0].count() == 0
    with pytest.raises(Exception, match="cells along an axis"):
        surface.iso_faces(f.withColumn("i", F.col("i") + 10_000_000)).collect()


def brute_distance(p, tri):
    best = (math.inf, None)
    for n, (a, b, c) in enumerate(tri):
        e = [math.inf]
        for s, t in ((a, b), (b, c), (c, a)):
            u = t - s
            w = min(1, max(0, np.dot(p - s, u) / max(np.dot(u, u), 1e-300)))
            e.append(np.linalg.norm(p - s - w * u))
        normal = np.cross(b - a, c - a)
        if np.linalg.norm(normal) > 1e-12:
            m = np.column_stack([b - a, c - a, normal])
            u, v, w = np.linalg.solve(m, p - a)
            if u >= 0 and v >= 0 and u + v <= 1:
                e.append(abs(w) * np.linalg.norm(normal))
        best = min(best, (min(e), n))
    return best


def test_nearest_triangles(spark):
    rng = np.random.default_rng(3)
    tri = [rng.uniform(-20, 20, 3) + rng.normal(0, s, (3, 3)) for s in (0.3, 0.3, 1, 1, 9, 30) for _ in range(12)]
    tri.append(np.array([[1.0, 1, 1]] * 3))  # a point
    tri.append(np.array([[5.0, 5, 5], [6, 6, 6], [8, 8, 8]]))  # a line
    points = [*rng.uniform(-25, 25, (60, 3)), np.array([900.0, 0, 0]), tri[3][0]]
    t = spark.createDataFrame([(n, *map(float, x.ravel())) for n, x in enumerate(tri)], "fid long, " + ", ".join(f"{a}{n} double" for n in range(3) for a in "xyz"))
    p = spark.createDataFrame([(n, *map(float, x)) for n, x in enumerate(points)] + [(99, None, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r["id"]: r["d"] for r in triangles.nearest_triangles(p, t).collect()}
    assert set(got) == set(range(len(points)))
    for n, x in enumerate(points):
        assert got[n] == pytest.approx(brute_distance(x, tri)[0], abs=1e-9)
    assert triangles.nearest_triangles(p, t.limit(0)).count() == 0


def octahedron(spark, r=10.0, shift=(0.0, 0.0, 0.0)):
    v = [(r, 0, 0), (-r, 0, 0), (0, r, 0), (0, -r, 0), (0, 0, r), (0, 0, -r)]
    f = [(4, 0, 2), (4, 2, 1), (4, 1, 3), (4, 3, 0), (5, 2, 0), (5, 1, 2), (5, 3, 1), (5, 0, 3)]
    vertex = spark.createDataFrame([(n, *(float(a + s) for a, s in zip(x, shift))) for n, x in enumerate(v)], "vid long, x double, y double, z double")
    return vertex, spark.createDataFrame([(n, *x) for n, x in enumerate(f)], "fid long, v0 long, v1 long, v2 long")


def test_radial_products_of_an_octahedron(spark):
    got = triangles.radial_product(*octahedron(spark, shift=(3.0, 4.0, 5.0)), 60.0, 10.0, (3.0, 4.0, 5.0), -30.0)
    by = {(r["row"], r["col"]): r for r in got.collect()}
    assert len(by) == 18 and not any(r["ambiguous"] for r in by.values())
    assert by[1, 0]["radius"] == pytest.approx(10) and by[1, 0]["elevation"] == pytest.approx(0) and by[1, 0]["reliability"] == pytest.approx(1 / math.sqrt(3))
    one = triangles.coverage(got, 60.0).first()
    assert one["coverage"] == 1 and one["by_angle"] == pytest.approx(1) and one["ambiguous"] == 0


def test_radial_products_against_all_triangles(spark):
    """Fine pixels over a body of small and large faces, some missing, and a second shell over part of it."""
    v1, f1 = octahedron(spark)
    v2, f2 = octahedron(spark, 25.0)
    vertex = v1.union(v2.withColumn("vid", F.col("vid") + 100))
    face = f1.where("fid != 2").union(f2.where("fid = 5").select(F.col("fid") + 100, *[F.col(c) + 100 for c in ("v0", "v1", "v2")]))
    got = {(r["row"], r["col"]): (r["radius"], r["ambiguous"]) for r in triangles.radial_product(vertex, face, 7.5, 0.0).collect()}
    at = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in vertex.collect()}
    tri = [[at[r[c]] for c in ("v0", "v1", "v2")] for r in face.collect()]
    want = {}
    for row in range(24):
        for col in range(48):
            lat, lon = math.radians(90 - (row + 0.5) * 7.5), math.radians((col + 0.5) * 7.5)
            d = np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
            ts = []
            for a, b, c in tri:
                t, u, v = np.linalg.solve(np.column_stack([d, a - b, a - c]), a)
                if t > 0 and u >= -1e-12 and v >= -1e-12 and u + v <= 1 + 1e-12:
                    ts.append(t)
            if ts:
                want[row, col] = (pytest.approx(min(ts)), max(ts) - min(ts) > 1e-6)
    assert got == want and any(x[1] for x in got.values()) and len(got) < 24 * 48


def test_vertices_are_rounded_as_by_sql(spark, tmp_path):
    """Many cuts lie halfway between two numbers of four decimals; each side must come out as from DuckDB."""
    rng = random.Random(5)
    rows = [(i, j / 100, k, 25.5 + (-u if (i + j + k) % 2 else 8 - u)) for i in range(60) for j in range(6) for k in range(6) for u in [rng.randrange(1, 800) / 100]]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["n14_iso_vertices"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got and got == sorted(con.sql(catalog.ORACLES["n14_iso_vertices"]).fetchall())


def test_rounding_in_binary(spark):
    numbers = [4.52875, -4.52875, 36.52875, 0.00005, -0.00005, 0.49999999999999994, 1e300, -1e300, 0.0, None, math.inf, -math.inf, math.nan, 123456789.98765]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(numbers)], "n long, x double")
    got = [r["x"] for r in catalog.rounded_in_binary(df).orderBy("n").collect()]
    want = [r[0] for r in duckdb.sql("select round(x, 4) + 0.0 from (select unnest($1::double[]) as x)", params=[[x for x in numbers]]).fetchall()]
    assert repr(got) == repr(want)
