"""Exact order statistics with the index rules that reconstruction reports use.

Values are first counted by group (a partial aggregate, so repeated values cost nothing), then a running count
names the element at an index. Nulls and NaNs are left out; groups without values give no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Index = Callable[[Column], Column]


def ceil_index(q: float) -> Index:
    """ceil(q (n - 1)): difference and alignment reports."""
    return lambda n: F.ceil(F.lit(q) * (n - 1))


def round_index(q: float) -> Index:
    """round(q (n - 1)): reconstruction summaries."""
    return lambda n: F.floor(F.lit(q) * (n - 1) + 0.5)


def p80_index(n: Column) -> Column:
    """ceil(0.8 (n + 1)) - 1, within the group."""
    return F.least(n - 1, F.greatest(F.lit(0), F.ceil(F.lit(0.8) * (n + 1)) - 1))


def upper_median(n: Column) -> Column:
    return F.floor(n / 2)


def quartile_index(n: Column) -> Column:
    return F.least(n - 1, F.floor(n * 3 / 4))


def bucket(value: Column) -> Column:
    """A number that never falls as the value grows: 256 steps for each doubling of its size, 1.2 million at most in all."""
    step = F.floor(F.least(F.lit(600_000.0), F.log2(F.abs(value)) * 256 + 300_000))
    return F.when(value > 0, step).when(value < 0, -step).otherwise(0).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict[str, Index], few: bool = False) -> DataFrame:
    """keys, n and one column for each pick: the element of the sorted values at that index. Equal values are counted
    before they are sorted. Without keys, or with few (of which one may hold a large share of all rows), the values of a key
    are sorted in buckets that follow each other, not in one task."""
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    cum = lambda w: F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(1)])
    if keys and not few:
        run = counted.withColumn("_cum", cum(own.orderBy("_v"))).withColumn("_n", F.sum("_k").over(own))
    else:
        counted = counted.withColumn("_b", bucket(F.col("_v").cast("double")))
        # a row for each bucket of a key: buckets are bounded, so one task may sort a key's
        before = counted.groupBy(*keys, "_b").agg(F.sum("_k").alias("_k")).select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], F.col("_b").alias("_at"), (cum(own.orderBy("_b")) - F.col("_k")).alias("_before"), F.sum("_k").over(own).alias("_n"))
        same = F.col("_b") == F.col("_at")
        for n, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_key{n}"))
        inside = Window.partitionBy(*keys, "_b").orderBy("_v")
        run = counted.withColumn("_cum", cum(inside)).join(before if keys else F.broadcast(before), same).withColumn("_cum", F.col("_cum") + F.col("_before"))
    return run.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_cum") > at(F.col("_n")), F.col("_v"))).alias(name) for name, at in picks.items()])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and a column for each share q: between the elements about q (n - 1), in proportion. Keys are few."""
    picks = {f"_{name}{side}": (lambda n, q=q, end=end: end(F.lit(q) * (n - 1)).cast("long")) for name, q in shares.items() for side, end in (("l", F.floor), ("h", F.ceil))}
    rest = {name: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)) for name, q in shares.items()}
    between = [(F.col(f"_{name}l") + (F.col(f"_{name}h") - F.col(f"_{name}l")) * rest[name]).alias(name) for name in shares]
    return order_statistics(df, keys, value, picks, True).select(*keys, "n", *between)


def median(column: str | Column) -> Column:
    """Mean of the two middle values."""
    return F.percentile(column, F.lit(0.5))


def robust_spread(df: DataFrame, keys: list[str], value: str, few: bool = False) -> DataFrame:
    """keys, n, med, mad and nmad (1.4826 mad) of the values' distances from their group's median. few: see order_statistics."""
    if few or not keys:
        mids = quantiles(df, keys, value, {"med": 0.5}).select(*[F.col(k).alias(f"_mid{n}") for n, k in enumerate(keys)], "n", "med")
        same = F.lit(True)
        for n, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_mid{n}"))
        off = df.join(F.broadcast(mids), same).withColumn("_off", F.abs(F.col(value) - F.col("med")))  # a row for each of few keys
        mad = quantiles(off, [*keys, "med"], "_off", {"mad": 0.5})
        return mad.withColumn("nmad", F.col("mad") * 1.4826).select(*keys, "n", "med", "mad", "nmad")
    mids = df.groupBy(*keys).agg(median(value).alias("med"))
    out = df.join(mids, keys).groupBy(*keys).agg(F.count(value).alias("n"), F.first("med").alias("med"), median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return out.withColumn("nmad", F.col("mad") * 1.4826)
