"""Gates on learned depths, reports on where a mesh's boundary lacks observations, and tracks put together for a solver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why an edge is on the boundary, in order, with how severe that is.
SEVERITY = {
    "none": 0.0,
    "extraction_or_postprocess": 0.5,
    "support_gate": 1.25,
    "absolute_tsdf": 1.5,
    "surface_weight": 2.0,
    "depth_spread": 2.5,
    "insufficient_source": 3.0,
    "no_observation": 4.0,
    "unclassified": 1.0,
}
REMATCH = ["support_gate", "absolute_tsdf", "depth_spread", "surface_weight"]
CAPTURE = ["no_observation", "insufficient_source"]
SECTORS = 12


def learned_depths(pixels: DataFrame, confidence: float = 0.5, observations: int = 3, spread: float = 0.015, difference: float = 0.03, margin: float = 0.1) -> DataFrame:
    """pixels with outcome, and depth and confidence after it.

    A pixel has depth, confidence, candidate, candidate_confidence, support, inverse_mean and inverse_spread. A
    candidate must be sure of itself, stand on enough camera geometry of little spread, and lie near the depth which
    that geometry expects. It then fills a pixel without depth, or replaces a depth that is further off and clearly
    less sure. Outcomes: none, confidence, geometry, difference (refused), kept, filled, replaced.
    """
    def real(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    expected = F.lit(1.0) / F.col("inverse_mean")
    off = lambda d: F.abs(d - expected) / F.greatest(expected, F.lit(1e-6))
    empty = ~real("depth") | (F.col("depth") <= 0)
    supported = (F.coalesce("support", F.lit(0)) >= observations) & real("inverse_mean") & (F.col("inverse_mean") > 0) & real("inverse_spread") & F.col("inverse_spread").between(0, spread)
    better = (off(F.col("candidate")) < off(F.col("depth"))) & (F.col("candidate_confidence") >= F.coalesce("confidence", F.lit(0.0)) + margin)
    outcome = (
        F.when(~real("candidate") | (F.col("candidate") <= 0), "none")
        .when(~real("candidate_confidence") | (F.col("candidate_confidence") < confidence), "confidence")
        .when(~supported, "geometry").when(off(F.col("candidate")) > difference, "difference").when(empty, "filled").when(better, "replaced").otherwise("kept")
    )
    trust = F.least(F.col("candidate_confidence"), 0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("inverse_spread") / max(spread, 1e-6))))
    taken = F.col("outcome").isin("filled", "replaced")
    out = pixels.withColumn("outcome", outcome)
    return out.withColumn("confidence", F.when(taken, trust).otherwise(F.col("confidence"))).withColumn("depth", F.when(taken, F.col("candidate")).otherwise(F.col("depth")))


def sector(x: Column, y: Column, z: Column) -> Column:
    """Sector of a direction: twelve of azimuth in each of three bands of height; -1 for no direction."""
    length = F.sqrt(x * x + y * y + z * z)
    turn = F.when(F.atan2(y, x) < 0, F.atan2(y, x) + 2 * math.pi).otherwise(F.atan2(y, x))
    azimuth = F.least(F.lit(SECTORS - 1), F.greatest(F.lit(0), F.floor(turn / (2 * math.pi) * SECTORS)))
    band = F.when(z / length < -0.35, 0).when(z / length > 0.35, 2).otherwise(1)
    return F.when(length > 2.220446049250313e-16, band * SECTORS + azimuth).otherwise(-1).cast("long")


def located(edges: DataFrame, center: tuple[float, float, float]) -> DataFrame:
    """Boundary edges (x, y, z of the middle, ...) with their sector about a centre."""
    return edges.withColumn("sector", sector(*[F.col(a) - c for a, c in zip("xyz", center)]))


def boundary_sectors(edges: DataFrame) -> DataFrame:
    """For each sector with edges: edges, length, severity, edges by number of sources, the chief cause, where to look from.

    Edges have sector, length, cause, sources (array) and a normal nx, ny, nz. Of causes with as many edges the more
    severe is the chief one. Two partial aggregations, so a full sector is no hot group.
    """
    weigh = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    rank = F.create_map(*[x for i, k in enumerate(SEVERITY) for x in (F.lit(k), F.lit(-i))])
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    k = F.least(F.lit(3), F.greatest(F.lit(0), F.size(F.array_distinct("sources"))))
    by = edges.groupBy("sector", "cause").agg(
        F.count("*").alias("n"), F.sum("length").alias("length"), *[F.count_if(k == i).alias(f"sources_{i}") for i in range(4)],
        *[F.sum(F.when(size > 1e-8, F.col(a) / size)).alias(a) for a in ("nx", "ny", "nz")],
    )
    whole = by.groupBy("sector").agg(
        F.sum("n").alias("edges"), F.sum("length").alias("length"), F.sum(F.col("n") * weigh[F.col("cause")]).alias("severity"), *[F.sum(f"sources_{i}").alias(f"sources_{i}") for i in range(4)],
        F.max_by("cause", F.struct("n", weigh[F.col("cause")], rank[F.col("cause")])).alias("cause"), *[F.sum(a).alias(a) for a in ("nx", "ny", "nz")],
    )
    return whole.withColumn("_s", size).select(*[c for c in whole.columns if c[0] != "n"], *[F.when(F.col("_s") > 1e-12, F.col(a) / F.col("_s")).alias(a) for a in ("nx", "ny", "nz")])


def source_coverage(edges: DataFrame) -> DataFrame:
    """For each source: edges it sees, those it sees alone, those shared, and the sector that it sees most of (ties: the first)."""
    seen = edges.select("sector", F.size(F.array_distinct("sources")).alias("k"), F.explode(F.array_distinct("sources")).alias("source"))
    by = seen.groupBy("source", "sector").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("alone"))
    known = F.when(F.col("sector") >= 0, F.struct(F.col("n").alias("n"), (-F.col("sector")).alias("s")))
    return by.groupBy("source").agg(F.sum("n").alias("edges"), F.sum("alone").alias("alone"), (F.sum("n") - F.sum("alone")).alias("shared"), F.coalesce(-F.max(known)["s"], F.lit(0)).alias("strongest"))


def gap_report(edges: DataFrame) -> DataFrame:
    """One row: boundary edges, those to match again, to capture again and to look for in the meshing, and what to do next."""
    count = lambda names, to: F.coalesce(F.count_if(F.col("cause").isin(names)), F.lit(0)).alias(to)
    t = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("sector") < 0).alias("unknown"), count(REMATCH, "rematch"), count(CAPTURE, "capture"), count(["extraction_or_postprocess"], "backend"))
    more = lambda a, *b: (F.col(a) > F.col(b[0])) & (F.col(a) > F.col(b[1]))
    action = F.when(more("capture", "rematch", "backend"), "additional_capture_required").when(more("backend", "capture", "rematch"), "mesh_backend_diagnosis").otherwise("existing_images_local_rematch")
    return t.withColumn("action", action)


def solver_input(cameras: DataFrame, obs: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Tracks (track, views, observations sorted by image) seen by at least two known cameras, and a row of status and counts.

    Observations have track, image and feature; of several of a track in one image the least feature stays.
    """
    known = obs.join(cameras.select("image").distinct(), "image", "left_semi").groupBy("track", "image").agg(F.min("feature").alias("feature"))
    tracks = known.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("image", "feature"))).alias("observations")).withColumn("views", F.size("observations").cast("long")).where(F.col("views") >= least)
    have = cameras.agg(F.count_distinct("image").alias("cameras"))
    status = F.when(F.col("cameras") < 2, "not_enough_cameras").when(F.col("tracks") == 0, "no_tracks").otherwise("ok")
    counts = tracks.agg(F.count("*").alias("tracks"), F.coalesce(F.sum("views"), F.lit(0)).alias("observations")).join(F.broadcast(have), F.lit(True))  # a row each
    return tracks, counts.withColumn("status", status)
