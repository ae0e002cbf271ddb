"""Task events: legal transitions, latest state, resume, and the same over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# States of a task, and the states it may go to from each; staying is always legal.
STATES = ["queued", "blocked", "running", "pause_requested", "paused", "cancel_requested", "succeeded", "failed", "cancelled", "interrupted"]
TRANSITIONS = {
    "queued": ["blocked", "running", "paused", "failed", "cancelled"],
    "blocked": ["queued", "paused", "failed", "cancelled"],
    "running": ["pause_requested", "cancel_requested", "succeeded", "failed", "cancelled", "paused"],
    "pause_requested": ["paused", "cancel_requested", "succeeded", "failed", "cancelled"],
    "paused": ["queued", "cancelled"],
    "cancel_requested": ["cancelled", "succeeded", "failed"],
    "interrupted": ["queued", "cancelled"],
}


def transitions(spark, table: dict[str, list[str]] | None = None) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in (table or TRANSITIONS).items() for b in bs], "before string, state string")


def checked(events: DataFrame, legal: DataFrame) -> DataFrame:
    """Events (run, moment, seq, state) with the state before and whether the step is legal; a first event is."""
    before = F.lag("state").over(Window.partitionBy("run").orderBy("moment", "seq"))
    rows = events.withColumn("before", before)
    known = legal.withColumn("_ok", F.lit(True))
    return rows.join(F.broadcast(known), ["before", "state"], "left").withColumn("legal", F.col("before").isNull() | (F.col("before") == F.col("state")) | F.coalesce("_ok", F.lit(False))).select("run", "moment", "seq", "before", "state", "legal")


def latest(events: DataFrame) -> DataFrame:
    """run, state, revision: a pre-aggregated argmax, so a busy run is no hot group."""
    return events.groupBy("run").agg(F.max_by("state", F.struct("moment", "seq")).alias("state"), F.count("*").alias("revision"))


def to_resume(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not yet done under the same configuration."""
    return wanted.join(done, keys, "left_anti")


def admission(queue: DataFrame, capacity: int) -> DataFrame:
    """Queued tasks in order of priority and sequence, admitted while their demands fit (a prefix); others say why not."""
    w = Window.partitionBy("pool").orderBy(F.desc("priority"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("demand").over(w)
    return queue.withColumn("used", used).withColumn("admitted", F.col("used") <= capacity).withColumn("blocked", F.when(F.col("used") > capacity, F.when(F.col("demand") > capacity, "too_large").otherwise("no_room")))


def windowed_counts(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Events by window and state; on a stream, late sets the watermark."""
    rows = events.withWatermark("moment", late) if late and events.isStreaming else events
    return rows.groupBy(F.window("moment", size).alias("w"), "state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "state", "n")
