"""Replaying stored files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import prepare


def replay_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    *,
    format: str = "parquet",
    files_per_trigger: int = 1,
) -> DataFrame:
    """File stream that takes `files_per_trigger` files per micro-batch, oldest first."""
    prepare(spark)
    schema = schema or spark.read.format(format).load(path).schema
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
