"""Readers for the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table *name* below *sf_dir* (one file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
