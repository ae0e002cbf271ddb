"""Readers of text and JSON formats as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names that marker tables use for one column, and names of roles.
ALIASES = {"id": ["id", "name", "label"], "x": ["x", "lon", "longitude", "easting"], "y": ["y", "lat", "latitude", "northing"], "z": ["z", "height", "altitude", "elevation"], "role": ["role", "type"]}
ROLES = {"control": ["control", "gcp", "control_point"], "check": ["check", "checkpoint", "check_point"], "tie": ["tie", "tie_point"]}


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """image, camera (null if the line names none) of each line that isn't empty or a comment."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) != '' and not startswith(trim(value), '#')").select(parts[0].alias("image"), F.get(parts, F.lit(1)).alias("camera"))


def xyz(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of lines with three numbers at least."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    out = spark.read.text(path).select(*[F.get(parts, F.lit(k)).try_cast("double").alias(a) for k, a in enumerate("xyz")])
    return out.where("x is not null and y is not null and z is not null")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, values (array of double) of lines 'key = number ...'."""
    key, value = F.trim(F.split_part("value", F.lit("="), F.lit(1))), F.trim(F.split_part("value", F.lit("="), F.lit(2)))
    return spark.read.text(path).where(F.contains("value", F.lit("="))).select(key.alias("key"), F.transform(F.split(value, r"\s+"), lambda x: x.try_cast("double")).alias("values"))


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertex (vid, x, y, z) and face (fid, v0, v1, v2) of an OBJ file; corners count from 0, polygons are fanned out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parts = F.split(F.trim("value"), r"\s+")
    # a mesh file is one unit: numbers follow from the order of its lines
    rows = lines.select("line", parts.alias("p"))
    from pyspark.sql.window import Window

    order = Window.partitionBy(F.lit(1)).orderBy("line")
    vertex = rows.where(F.col("p")[0] == "v").select((F.row_number().over(order) - 1).cast("long").alias("vid"), *[F.col("p")[k + 1].cast("double").alias(a) for k, a in enumerate("xyz")])
    corner = F.transform(F.slice("p", 2, F.size("p")), lambda x: F.split_part(x, F.lit("/"), F.lit(1)).cast("long") - 1)
    fans = rows.where(F.col("p")[0] == "f").select("line", corner.alias("c")).where("size(c) >= 3").select("line", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k"))
    face = fans.select("line", "k", F.col("c")[0].alias("v0"), F.get("c", F.col("k")).alias("v1"), F.get("c", F.col("k") + 1).alias("v2"))
    return vertex, face.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("line", "k")) - 1).cast("long").alias("fid"), "v0", "v1", "v2")


def role(column: Column) -> Column:
    """The canonical role of a name; tie where unknown."""
    low = F.lower(F.trim(column))
    out = F.lit("tie")
    for name, known in ROLES.items():
        out = F.when(low.isin(known), name).otherwise(out)
    return out


def markers(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """id, x, y, z, role, usable of a marker table with a header, under any of the known names."""
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"')
    have = {c.strip().lower(): c for c in raw.columns}

    def pick(name: str) -> Column:
        found = [F.col(f"`{have[a]}`") for a in ALIASES[name] if a in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = raw.select(F.trim(pick("id")).alias("id"), *[pick(a).try_cast("double").alias(a) for a in "xyz"], role(pick("role")).alias("role"))
    return out.withColumn("usable", F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def tie_points(spark: SparkSession, path: str) -> DataFrame:
    """track, image, feature of a JSON document with an array of tie points."""
    schema = "tracks array<struct<id:long, observations:array<struct<image:long, feature:long>>>>"
    t = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("tracks").alias("t"))
    return t.select(F.col("t.id").alias("track"), F.explode("t.observations").alias("o")).select("track", "o.image", "o.feature")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, status, config of completed frames of a JSON manifest, by name."""
    schema = "frames array<struct<name:string, status:string, config:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("frames")).where("status = 'completed'").orderBy("name")
