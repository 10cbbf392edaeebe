"""Reading the bundled parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
