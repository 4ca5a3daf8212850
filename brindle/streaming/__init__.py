"""Relations that grow: selections and projections work on them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def follow(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """The rows of a folder's Parquet files, those that come later included."""
    return spark.readStream.schema(schema).parquet(folder)
