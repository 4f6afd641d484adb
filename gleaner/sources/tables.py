"""Reading provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; Spark's own split sizes set the parallelism."""
    return spark.read.parquet(path)
