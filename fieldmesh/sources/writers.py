"""Writers: tables that change only where their content does, text point clouds, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hash of each group's rows, whatever their order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(row.cast("decimal(38,0)")).alias("_h")).select(*keys, F.sha2(F.concat_ws(":", "_n", "_h"), 256).alias("hash"))


def changed(new: DataFrame, old_hashes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups whose content is not yet stored."""
    fresh = content_hash(new, keys).join(old_hashes, [*keys, "hash"], "left_anti").select(*keys)
    return new.join(fresh, keys, "left_semi")


def write_if_changed(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends changed groups below path and their hashes beside it; the number of groups written."""
    spark = df.sparkSession
    hashes = f"{path}/_hashes"
    old = spark.read.schema(content_hash(df, keys).schema).parquet(hashes) if _exists(spark, hashes) else content_hash(df.limit(0), keys)
    rows = changed(df, old, keys)
    n = rows.select(*keys).distinct().count()
    if n:
        content_hash(rows, keys).write.mode("append").parquet(hashes)
        rows.write.mode("append").parquet(f"{path}/rows")
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ply_text(points: DataFrame, path: str) -> int:
    """An ASCII PLY body as text parts under path/body and its header under path/header; the number of points."""
    n = points.count()
    points.select(F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"]).alias("value")).write.mode("overwrite").text(f"{path}/body")
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property double {a}" for a in "xyz"], "end_header"]
    points.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    return n


def validated_ply(spark: SparkSession, header: str, body: str) -> DataFrame:
    """promised, found, valid: vertices that a PLY header names, and lines of its body that are points."""
    told = spark.read.text(header).select(F.max(F.regexp_extract("value", r"element vertex (\d+)", 1).try_cast("long")).alias("promised"))
    whole = F.rlike("value", F.lit(r"^\s*[-+0-9.eE]+\s+[-+0-9.eE]+\s+[-+0-9.eE]+"))
    found = spark.read.text(body).agg(F.count_if(whole).alias("found"), F.count_if(F.trim("value") != "").alias("_lines"))
    valid = F.coalesce((F.col("promised") == F.col("found")) & (F.col("found") == F.col("_lines")), F.lit(False))
    return told.join(found, F.lit(True)).select("promised", "found", valid.alias("valid"))  # a row each


def obj_text(vertex: DataFrame, face: DataFrame, path: str) -> None:
    """An OBJ file of vertices (vid, x, y, z) and triangles (fid, v0, v1, v2), in order; a mesh file is one unit, written by one task."""
    v = vertex.select(F.lit(0).alias("part"), F.col("vid").alias("at"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = face.select(F.lit(1).alias("part"), F.col("fid").alias("at"), F.concat_ws(" ", F.lit("f"), *[F.col(c) + 1 for c in ("v0", "v1", "v2")]).alias("value"))
    v.union(f).repartition(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def report(df: DataFrame) -> DataFrame:
    """A one-row table as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
