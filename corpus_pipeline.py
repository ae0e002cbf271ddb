"""The corpus pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmesh.llm.stages import STAGES, run_stages

#: No SQL can express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(spark, sf_dir, STAGES)
