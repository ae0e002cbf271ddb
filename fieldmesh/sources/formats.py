"""Readers and writers of point, mesh, control-network and laser documents in text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    """line, x, y, z of the vertices of an ASCII PLY file that names x, y and z first; the header is one line of a few at the top."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("a"))
    end = F.array_position("a", "end_header").cast("int")
    count = F.regexp_extract(F.array_join(F.slice("a", 1, end), "\n"), r"element vertex (\d+)", 1).cast("int")
    body = lines.select(F.posexplode(F.slice("a", end + 1, count)).alias("line", "value"))
    p = F.split(F.trim("value"), r"\s+")
    return body.select("line", *[F.get(p, F.lit(k)).try_cast("double").alias(a) for k, a in enumerate("xyz")])


def inspected(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Elements of a mesh or cloud file, counted without building it: vertices, faces."""
    t = spark.read.text(path).select(F.trim("value").alias("v"))
    if kind == "obj":
        return t.agg(F.count_if(F.startswith("v", F.lit("v "))).alias("vertices"), F.count_if(F.startswith("v", F.lit("f "))).alias("faces"))
    if kind == "xyz":
        return t.agg(F.count_if(F.rlike("v", F.lit(r"^[-+0-9.eE]+[\s,]+[-+0-9.eE]+[\s,]+[-+0-9.eE]+"))).alias("vertices"), F.lit(0).cast("long").alias("faces"))
    number = lambda what: F.coalesce(F.max(F.regexp_extract("v", rf"^element {what} (\d+)$", 1).try_cast("long")), F.lit(0)).alias(what)
    return t.agg(number("vertex"), number("face")).toDF("vertices", "faces")


def control_network(documents: DataFrame) -> DataFrame:
    """point, kind, measures, serials of PVL control-network texts (column text): one row for each Object = ControlPoint."""
    points = F.explode(F.filter(F.split("text", r"(?i)Object\s*=\s*ControlPoint"), lambda x: F.rlike(x, F.lit(r"(?i)PointId\s*=")))).alias("p")
    pick = lambda name: F.trim(F.regexp_extract("p", rf"(?i){name}\s*=\s*([^\r\n]+)", 1))
    serials = F.regexp_extract_all("p", F.lit(r"(?i)SerialNumber\s*=\s*([^\r\n]+)"), F.lit(1))
    return documents.select(points).select(pick("PointId").alias("point"), pick("PointType").alias("kind"), F.size(serials).alias("measures"), F.transform(serials, lambda x: F.trim(x)).alias("serials"))


LASER = "shots array<struct<id:string, time:double, latitude:double, longitude:double, radius:double, range:double, sigma:double>>"


def laser_shots(documents: DataFrame) -> DataFrame:
    """Shots of JSON texts (column text), with the reasons why a shot is not usable."""
    s = documents.select(F.inline(F.from_json("text", LASER)["shots"]))
    bad = [("no_id", F.col("id").isNull()), ("no_time", F.col("time").isNull()), ("latitude", ~F.coalesce(F.col("latitude").between(-90, 90), F.lit(False))), ("longitude", ~F.coalesce(F.col("longitude").between(-180, 360), F.lit(False))), ("radius", ~F.coalesce(F.col("radius") > 0, F.lit(False))), ("sigma", F.coalesce(F.col("sigma") <= 0, F.lit(False)))]
    return s.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad])))


def pair_key_parts(key: Column) -> tuple[Column, Column]:
    """The two names of a pair key, escapes undone."""
    parts = F.split(F.regexp_replace(key, r"\\\|", "\u0001"), r"\|")
    undo = lambda x: F.regexp_replace(F.regexp_replace(x, "\u0001", "|"), r"\\\\", r"\\")
    return undo(parts[0]), undo(parts[1])


def merged_json(base: dict, more: dict) -> dict:
    """Objects merged deeply, more winning; documents are settings of bounded size."""
    out = dict(base)
    for k, v in more.items():
        out[k] = merged_json(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolved_aliases(tokens: DataFrame, images: DataFrame) -> DataFrame:
    """Tokens with the one image (idx, path) that has them as path, file name or stem; a token of two images is an error on use."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    alias = images.select("idx", F.explode(F.array_distinct(F.transform(F.array("path", name, stem), lambda x: F.lower(x)))).alias("alias"))
    one = alias.groupBy("alias").agg(F.count_distinct("idx").alias("k"), F.min("idx").alias("idx"))
    checked = F.when(F.col("k") > 1, F.raise_error(F.concat(F.lit("ambiguous image "), F.col("token"))).cast("long")).otherwise(F.col("idx"))
    return tokens.withColumn("alias", F.lower("token")).join(one, "alias", "left").select("token", checked.alias("idx"))


def registry() -> tuple[dict, object]:
    """A registry of functions by id, and the decorator that adds to it; ids are lower case with dots and dashes."""
    found: dict = {}

    def register(name: str):
        if not re.fullmatch(r"[a-z][a-z0-9_.-]*", name) or name in found:
            raise ValueError(f"{name!r} is no free id")

        def add(f):
            found[name] = f
            return f

        return add

    return found, register
