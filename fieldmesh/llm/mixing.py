"""Mixing sources to target weights: every source is cut at its budget in a hash-random order.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+`. Sources in code-point order (null last) weigh
WEIGHTS in turn and share SHARE of all words; a target stops at EPOCHS times its source's size, and what is over goes to
the others by weight until none is above. Of a target, whole epochs take every document; the rest of it is a prefix of the source in
the order of the documents' keys (md5 of id and text), cut within a document where the budget ends there. So sources give
floor(target) words each, and reruns agree.

Keys are uniform, so buckets of equal key ranges are a range sort of every source without sampling: running sums over
buckets, then within each bucket, give every document's place. A bucket holds about BUCKET rows whatever the share of its source.
Only sums over sources reach the driver; sources themselves, however many, are ranked and filled as a table.

Null and empty texts have size 0 and give nothing; a null source is a source of its own, unlike one named ""; a null doc_id
counts as the empty text in a key; rows that repeat an id and a text are told apart by size alone, which is equal, so results stay the
same up to the order of equal rows; an empty table gives an empty table; columns other than doc_id, text and source are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, lean, partitions, pieces

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
BUCKET = 50_000
#: Buckets at least, for each shuffle partition.
SPREAD = 4
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (binary), size of every row."""

    @lean
    def run(batches):
        for b in batches:
            found = []
            for _, _, data, off in pieces(b):
                word = ~_space[data]
                begins = word.copy()
                begins[1:] &= ~word[:-1]
                inner = off[1:-1][off[1:-1] < len(data)]
                begins[inner] = word[inner]  # a text's first byte
                found.append(np.diff(np.concatenate([[0], np.cumsum(begins)])[off]))
            size = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("key"), pa.array(size)], ["doc_id", "source", "key", "size"])

    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.unhex(F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))
    rows = docs.select(doc.alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, key binary, size long")


def _name(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("."), source), F.lit(""))


def ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each) with place, their number in code-point order from 0, null last: a range sort, then running
    sums of the parts' rows."""
    parts = partitions(sources.sparkSession)
    part = kept(sources.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    order = Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))
    before = part.groupBy("part").agg(F.count("*").alias("rows"))
    before = before.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # a row for each part
    return part.withColumn("at", F.row_number().over(order) - 1).join(before, "part").select(*sources.columns, (F.col("at") + F.col("before")).alias("place"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of sources (source, source_size: one row each): a level is raised until what sources
    give at it, each at most its cap, is the share of all words."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = kept(ranked(totals).select("source", "source_size", weight.cast("double").alias("weight"), (F.lit(float(epochs)) * F.col("source_size")).alias("cap")), "weights")
    whole, level = share * (table.agg(F.sum("source_size")).first()[0] or 0), -1.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        given, rest = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, (whole - given) / rest if rest else level
        if level <= before:
            break
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows = kept(sizes(docs), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    buckets = max(rows.count() // BUCKET + 1, SPREAD * partitions(docs.sparkSession))
    high = F.conv(F.hex(F.substring("key", 1, 6)), 16, 10).cast("long")  # 48 bits: of equal steps over all buckets
    placed = rows.withColumns({"name": _name(F.col("source")), "bucket": F.floor(high * F.lit(buckets / 2.0**48)).cast("long")})
    sums = placed.groupBy("name", "bucket").agg(F.sum("size").alias("held"))
    before = F.sum("held").over(Window.partitionBy("name").orderBy("bucket")) - F.col("held")
    plan = kept(targets(totals, weights, share, epochs), "targets").withColumn("name", _name(F.col("source"))).drop("source")
    starts = kept(sums.withColumn("before", before).drop("held").join(plan, "name"), "starts")
    inside = Window.partitionBy("name", "bucket").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("through", F.sum("size").over(inside)).join(starts, ["name", "bucket"])
    times = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    left = F.floor("target") - times * F.col("source_size") - F.col("before") - (F.col("through") - F.col("size"))
    taken = times * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return running.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS whole FROM s),
f AS (SELECT a.source, (any_value(a.whole) - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.weight <= a.cap / a.weight), 0)) / nullif(coalesce(sum(b.weight) FILTER (WHERE b.cap / b.weight > a.cap / a.weight), 0), 0) AS level, any_value(a.cap / a.weight) AS ratio FROM w a, w b GROUP BY a.source),
z AS (SELECT (any_value(whole) / sum(weight)) AS level, -1.0 AS ratio FROM w),
l AS (SELECT max_by(level, ratio) AS level FROM (SELECT level, ratio FROM f UNION ALL SELECT level, ratio FROM z) WHERE level >= ratio),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE level * weight END AS target FROM w, l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times, sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, floor(target) - times * source_size - before)))::BIGINT AS taken FROM r"""
