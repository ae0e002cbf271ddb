"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, neardup, suffixdedup
from .common import dropped_since, kept, written

#: A text's language must be likelier than all others together.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or with no language that is sure enough, go; copies share
    their fate; an empty table stays empty; without labelled rows no language is known, and all go."""
    return langid.accepted(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that with the smallest doc_id (nulls last) and, where that id
    has several texts, the least hash of its text. Documents without words (null and empty texts too) all stay; of rows
    that repeat doc_id and text one stays; an empty table stays empty."""
    found = kept(neardup.grouped(docs), "near-duplicates")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = found.where("root is not null").groupBy("root").agg(F.min(first).alias("x")).select("x.doc_id", "x.text_hash")
    stays = best.unionByName(found.where("root is null").select("doc_id", "text_hash")).toDF("kept_id", "kept_hash").distinct()
    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (hashed == F.col("kept_hash")), "left_semi")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():  # only then are there rows to drop
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long strings that also start earlier go; every document stays, maybe empty (null texts become empty). Rows
    that repeat a doc_id are ordered by a hash of their text; an empty table stays empty."""
    more = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carried = F.struct(*(F.col(f"`{c}`") for c in more)) if more else F.lit(None).cast("int")
    left = suffixdedup.remove_repeats(docs.select("doc_id", "text", carried.alias("carried")), True, ("carried",))
    back = {c: F.col(f"carried.`{c}`").alias(c) for c in more} | {"n_chars": F.length("text").cast("long").alias("n_chars")}
    return left.select(*(back.get(c, F.col(c)) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leak of a benchmark item go; null and empty texts have none; an empty table, or list, changes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, as counts and digests; null texts count as empty, repeated rows give repeated rows."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("suffix_dedup", repeats), ("decontamination", decontaminated), ("bpe", tokens)]


def run_stages(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """The last stage's rows; each stage before is written, and the tables it needed on the way are deleted then, with its input."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in stages[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped_since(spark, mark, docs)
    return stages[-1][1](spark, docs, sf_dir)
