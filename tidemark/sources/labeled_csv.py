"""Labelled wide CSV files (one row per reading, one column per metric)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expr import US, parse_ts
from tidemark.operators.scan import number_rows
from tidemark.session import prepare

# Columns that are never metrics, and the start of made-up times.
NEVER_METRICS = ("anomaly", "label")
FIRST_TIME = "2024-01-01"


def numeric_columns(df: DataFrame, timestamp_col: str, label_col: str | None) -> list[str]:
    skip = {timestamp_col, label_col, *NEVER_METRICS}
    return [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def wide_to_events(
    df: DataFrame,
    *,
    device_id: str = "replay-device-001",
    sensor_type: str = "industrial",
    timestamp_col: str = "timestamp",
    value_cols: list[str] | None = None,
    label_col: str | None = "is_anomaly",
    file: str = "",
) -> DataFrame:
    """Wide rows to sensor events.

    A column `row` gives the position in the file; without it rows are
    numbered by time. Without a time column, times are a second apart.
    """
    value_cols = value_cols or numeric_columns(df.drop("row"), timestamp_col, label_col)
    cells = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in value_cols])
    metrics = F.map_from_entries(F.filter(cells, lambda e: e["value"].isNotNull()))  # an empty cell is no reading
    if timestamp_col in df.columns:
        kind = df.schema[timestamp_col].dataType
        time = F.col(timestamp_col).cast("timestamp")
        if isinstance(kind, T.StringType):
            time = parse_ts(F.col(timestamp_col))
        if "row" not in df.columns:
            df = number_rows(df.withColumn("_time", time), ["_time"], "row").drop("_time")
    else:
        start = F.unix_micros(F.lit(FIRST_TIME).cast("timestamp"))
        time = F.timestamp_micros(start + F.col("row") * US)
    label = F.lit(None).cast("boolean")
    if label_col and label_col in df.columns:
        label = F.col(label_col).cast("int") != 0
    return df.select(
        F.lit(device_id).alias("device_id"),
        F.lit(sensor_type).alias("sensor_type"),
        time.alias("timestamp"),
        metrics.alias("metrics"),
        F.col("row").cast("bigint").alias("sequence"),
        F.create_map(F.lit("source"), F.lit("replay"), F.lit("file"), F.lit(file)).alias("tags"),
        F.lit(None).cast("string").alias("tenant_id"),
        label.alias("is_anomaly"),
        F.when(label, "dataset_label").alias("anomaly_label"),
    )


def read_labeled_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events of one labelled CSV file, with ids from file name and row."""
    df = prepare(spark).read.csv(path, header=True, inferSchema=True)
    timestamp_col = options.get("timestamp_col", "timestamp")
    if timestamp_col not in df.columns:
        # line order is the only order such a file has; ids grow along it
        df = number_rows(df.withColumn("_line", F.monotonically_increasing_id()), ["_line"], "row").drop("_line")
    file = options.pop("file", path.rstrip("/").rsplit("/", 1)[-1])
    events = wide_to_events(df, file=file, **options)
    return events.withColumn("event_id", F.sha2(F.concat_ws("|", F.lit(file), F.col("sequence").cast("string")), 256))
