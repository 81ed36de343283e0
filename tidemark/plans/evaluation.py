"""Evaluation from a labelled file to a stored report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import DEFAULT_CATALOG, Catalog, Settings
from tidemark.operators import evaluate as ev
from tidemark.operators.enrich import resolve_tenant
from tidemark.operators.scoring import detect
from tidemark.session import scratch
from tidemark.sources.labeled_csv import read_labeled_csv


def evaluate_csv(
    spark: SparkSession,
    path: str,
    *,
    device_id: str = "eval-device-001",
    sensor_type: str = "industrial",
    label_col: str = "is_anomaly",
    dataset: str | None = None,
    cfg: Settings = Settings(),
    catalog: Catalog = DEFAULT_CATALOG,
) -> DataFrame:
    """The report of a labelled CSV (a file, or a folder of parts): its readings are one device's, scored in order of time.

    The events are written to the shared folder once, as the report reads them more than once.
    """
    name = dataset or path.rstrip("/").rsplit("/", 1)[-1]
    read = read_labeled_csv(spark, path, device_id=device_id, sensor_type=sensor_type, label_col=label_col, file=name)
    out = scratch(spark, "labelled")
    resolve_tenant(read, cfg.tenancy).write.parquet(out)
    events = spark.read.parquet(out)
    found = detect(events.filter("is_anomaly IS NOT NULL"), cfg.detection, catalog)
    return ev.report(name, events, found, cfg.evaluation, cfg.detection.alert_threshold)


def write_report(reports: DataFrame, path: str) -> None:
    """Reports as JSON, one line a dataset; a report of the same path is replaced."""
    ev.report_json(reports).select("report").coalesce(1).write.mode("overwrite").text(path)
