"""Registered queries over binary files: written to the shared folder by a two-phase sink, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmesh.plans.catalog import query, rounded
from fieldmesh.plans.catalog_files import place
from fieldmesh.sources import binary


@query("s08_point_files", "SELECT 's' || l_suppkey || '.match' AS name, count(*) AS pairs, sum(l_quantity)::DOUBLE AS xa, sum(round(l_discount * 100))::DOUBLE AS ya, sum(round(l_tax * 100))::DOUBLE AS xb, sum(l_linenumber)::DOUBLE AS yb FROM lineitem GROUP BY 1")
def point_files(spark, d):
    """A point file for each supplier's lines."""
    li, path = spark.read.parquet(f"{d}/lineitem.parquet"), place(spark, "points")
    m = li.select(F.concat(F.lit("s"), "l_suppkey", F.lit(".match")).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.col("l_quantity").alias("xa"), F.round(F.col("l_discount") * 100).alias("ya"), F.round(F.col("l_tax") * 100).alias("xb"), F.col("l_linenumber").cast("double").alias("yb"))
    binary.write_points(m, path)
    return binary.read_points(spark, path).groupBy("name").agg(F.count("*").alias("pairs"), *[F.sum(c).alias(c) for c in ("xa", "ya", "xb", "yb")])


@query("k07_geotiff", "SELECT l_suppkey::BIGINT AS r, (l_partkey % 97)::BIGINT AS c, round(avg(l_quantity)::FLOAT::DOUBLE, 4) AS value FROM lineitem GROUP BY 1, 2")
def geotiff(spark, d):
    """A grid as tiled GeoTIFF files of 128 by 128 cells."""
    li, path = spark.read.parquet(f"{d}/lineitem.parquet"), place(spark, "rasters")
    cells = li.groupBy(F.col("l_suppkey").cast("long").alias("r"), (F.col("l_partkey") % 97).cast("long").alias("c")).agg(F.avg("l_quantity").alias("value"))
    binary.write_geotiffs(cells, path, 0.5, (500_000.0, 4_000_000.0), block=128)
    return rounded(binary.read_geotiffs(spark, path, (500_000.0, 4_000_000.0)))
