"""Reports: summaries, histograms, gates, residuals, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmesh.functions.order_stats import order_statistics, round_index


def numeric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, low, high, mean, p50, p84, p95 (elements at round(q (n - 1))); keys are few."""
    plain = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    ranks = order_statistics(df, keys, value, {"p50": round_index(0.5), "p84": round_index(0.84), "p95": round_index(0.95)}, few=True)
    return ranks.join(F.broadcast(plain), keys) if keys else ranks.join(F.broadcast(plain), F.lit(True))


def residual_statistics(df: DataFrame, role: str, residual: str, limit: float) -> DataFrame:
    """By role: finite residuals, inliers (none for check points), mean, rms and maximum of their sizes."""
    size = F.abs(F.col(residual))
    return df.where(F.col(residual).isNotNull() & ~F.isnan(residual) & (size < float("inf"))).groupBy(role).agg(
        F.count("*").alias("n"), F.count_if((size <= limit) & (F.col(role) != "check")).alias("inliers"), F.avg(size).alias("mean"), F.sqrt(F.avg(size * size)).alias("rms"), F.max(size).alias("largest")
    )


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def track_lengths(obs: DataFrame) -> DataFrame:
    """length, tracks."""
    return obs.groupBy("track").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("tracks"))


def funnel(df: DataFrame, stages: dict[str, object]) -> DataFrame:
    """One row: how many rows each stage's condition holds for."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in stages.items()])


def normalised_weights(edges: DataFrame, weight: str) -> DataFrame:
    """Weights over the largest one; unchanged if that is 0."""
    top = edges.agg(F.max(weight).alias("_top"))
    return edges.join(F.broadcast(top), F.lit(True)).withColumn("weight", F.when(F.col("_top") != 0, F.col(weight) / F.col("_top")).otherwise(F.col(weight).cast("double"))).drop("_top")


def weighted_median_bins(df: DataFrame, keys: list[str], value: str, weight: str, low: float, high: float, bins: int) -> DataFrame:
    """keys, med (centre of the bin where the running weight passes half; an exact half tie averages with the next bin that has
    weight), top (heaviest bin, first among equals)."""
    width = (high - low) / bins
    binned = df.where((F.col(value) >= low) & (F.col(value) <= high)).withColumn("_b", F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width))).groupBy(*keys, "_b").agg(F.sum(weight).alias("_w")).where("_w > 0")
    own = Window.partitionBy(*[F.col(k) for k in keys])
    run = binned.withColumn("_cum", F.sum("_w").over(own.orderBy("_b"))).withColumn("_all", F.sum("_w").over(own)).withColumn("_next", F.lead("_b").over(own.orderBy("_b")))
    centre = lambda b: low + (b + 0.5) * width
    med = F.when(F.col("_cum") * 2 == F.col("_all"), (centre(F.col("_b")) + centre(F.coalesce("_next", "_b"))) / 2).when(F.col("_cum") * 2 > F.col("_all"), centre(F.col("_b")))
    return run.groupBy(*keys).agg(F.min_by(med, F.when(med.isNotNull(), F.col("_b"))).alias("med"), F.max_by("_b", F.struct("_w", -F.col("_b"))).alias("top"))


def completeness(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """valid, missing, share of the expected cells (r, c)."""
    both = expected.join(cells.select("r", "c", F.lit(1).alias("_has")), ["r", "c"], "left")
    return both.agg(F.count("_has").alias("valid"), F.count_if(F.col("_has").isNull()).alias("missing"), (F.count("_has") / F.count("*")).alias("share"))


def status(warnings: list, advisories: list):
    """blocked if any warning holds, warn if any advisory does, else ok."""
    any_ = lambda xs: reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in xs], F.lit(False))
    return F.when(any_(warnings), "blocked").when(any_(advisories), "warn").otherwise("ok")


def baseline_comparison(now: DataFrame, baseline: DataFrame, limits: dict[str, float]) -> DataFrame:
    """metric, ratio, failed of one-row tables: current over baseline against the largest ratio allowed."""
    both = now.select([F.col(m).alias(f"now_{m}") for m in limits]).join(F.broadcast(baseline.select([F.col(m).alias(f"was_{m}") for m in limits])), F.lit(True))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col(f"was_{m}") != 0, F.col(f"now_{m}") / F.col(f"was_{m}")).alias("ratio"), F.lit(float(x)).alias("_limit")) for m, x in limits.items()])
    return both.select(F.explode(rows).alias("x")).select("x.metric", "x.ratio", (F.col("x.ratio") > F.col("x._limit")).alias("failed"))
