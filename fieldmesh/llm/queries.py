"""The queries of this subpackage, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, urlfilter
from .common import documents


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixdedup

    return suffixdedup.remove_repeats(documents(spark, sf_dir))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import scoring

    return scoring.score(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import imatch

    return imatch.fingerprints(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.evaluate(urlfilter.page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), urlfilter.entries(spark))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import variants

    return variants.variants(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_duplicates, op2_toxicity, op3_language_id, op4_suffix_dedup, op5_ppm, op6_bpe, op7_imatch, op8_licenses, op9_decontaminate, op10_url_filter, op11_spelling_variants, op12_whitening, op13_source_mix)}
ORACLES: dict[str, str] = {"op10_url_filter": urlfilter.ORACLE, "op13_source_mix": mixing.ORACLE}
