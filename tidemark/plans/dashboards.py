"""Dashboard panels: counts, rates and averages over time ranges.

Panels that look back from "now" take the time as `as_of`, so a result can be
repeated. Charts take an interval and optionally a (from, to) range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import half_up
from tidemark.operators.metrics import interpolated, merged_sketch, quantile_sketch, sketch_quantiles
from tidemark.operators.windows import time_bucket


UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def since(df: DataFrame, as_of: Column, lookback: str = "1 hour", tenant_regex: str | None = None) -> DataFrame:
    """Rows after as_of - lookback and up to as_of; the pattern may match anywhere in the tenant. A stored table's dates are pruned."""
    first = as_of - F.expr(f"interval {lookback}")
    out = df.filter((F.col("timestamp") > first) & (F.col("timestamp") <= as_of))
    if "date" in df.columns:
        out = out.filter((F.col("date") >= F.to_date(first)) & (F.col("date") <= F.to_date(as_of)))
    return out if tenant_regex is None else out.filter(F.col("tenant_id").rlike(tenant_regex))


def in_range(df: DataFrame, between: tuple[Column, Column] | None, time: str = "timestamp") -> DataFrame:
    return df if between is None else df.filter(F.col(time).between(*between))


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def event_count(df, as_of, lookback="1 hour", tenant_regex=None) -> DataFrame:
    return since(df, as_of, lookback, tenant_regex).agg(_count("events"))


def active_devices(df, as_of, lookback="1 hour", tenant_regex=None, *, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return since(df, as_of, lookback, tenant_regex).agg(count("device_id").alias("devices"))


def anomaly_count(anomalies, as_of, lookback="1 hour", tenant_regex=None) -> DataFrame:
    return since(anomalies, as_of, lookback, tenant_regex).filter("is_anomaly").agg(_count("anomalies"))


def avg_ingest_latency(df, as_of, lookback="1 hour") -> DataFrame:
    return since(df, as_of, lookback).agg(half_up(F.avg("ingest_latency_ms"), 2).alias("latency"))


def event_rate(df, interval, between=None) -> DataFrame:
    """Events per bucket, and per second of it."""
    width = F.col("_w.end").cast("double") - F.col("_w.start").cast("double")
    return (
        in_range(df, between)
        .groupBy(F.window("timestamp", interval).alias("_w"))
        .agg(_count("events"))
        .select(F.col("_w.start").alias("bucket"), "events", (F.col("events") / width).alias("events_per_second"))
    )


def events_by_type(df, interval, between=None) -> DataFrame:
    return time_bucket(in_range(df, between), interval, [_count("events")], ["sensor_type"])


def metric_avg(df, field: str, sensor_type: str, interval, between=None) -> DataFrame:
    """Average of one metric of one sensor type, over events that report it."""
    has = (F.col("sensor_type") == sensor_type) & F.map_contains_key("metrics", F.lit(field))
    value = F.avg(F.try_element_at("metrics", F.lit(field))).alias(field)
    return time_bucket(in_range(df, between).filter(has), interval, [value])


def latency_quantiles(df, interval, between=None, *, approximate: bool = False) -> DataFrame:
    """Average and interpolated 95th percentile per bucket; `approximate` trades exactness for one small sketch. A panel
    that is drawn again and again reads a table of `latency_sketch` rows instead."""
    rows = in_range(df, between)
    if approximate:
        p95 = F.percentile_approx("ingest_latency_ms", 0.95).alias("p95")
        return time_bucket(rows, interval, [F.avg("ingest_latency_ms").alias("avg"), p95])
    start = F.window("timestamp", interval)["start"].alias("bucket")
    exact = interpolated(rows.select(start, "ingest_latency_ms"), "ingest_latency_ms", 0.95, ["bucket"], "p95")
    return exact.withColumnRenamed("mean", "avg")


def latency_sketch(df, interval) -> DataFrame:
    """Rows of a table of sketches, one sketch a bucket: each batch adds its own, `sketched_quantiles` adds them up."""
    start = F.window("timestamp", interval)["start"].alias("bucket")
    return quantile_sketch(df.select(start, "ingest_latency_ms"), "ingest_latency_ms", ["bucket"])


def sketched_quantiles(sketches, fractions=(0.95,)) -> DataFrame:
    """Per bucket: samples, mean and quantiles, off by less than 0.28 percent."""
    return sketch_quantiles(merged_sketch(sketches, ["bucket"]), fractions, ["bucket"])


def anomaly_rate(anomalies, interval, between=None) -> DataFrame:
    aggs = [F.count_if("is_anomaly").alias("anomalies"), F.avg("score").alias("avg_score")]
    return time_bucket(in_range(anomalies, between), interval, aggs)


def severity_over_time(anomalies, interval, between=None) -> DataFrame:
    return time_bucket(in_range(anomalies, between).filter("is_anomaly"), interval, [_count("count")], ["severity"])


def window_mean_avg(stats, field: str, interval, between=None) -> DataFrame:
    """Average of the window means of one field, by window start."""
    rows = in_range(stats, between, "window_start").filter(F.col("field") == field)
    return time_bucket(rows, interval, [F.avg("mean").alias(field)], time="window_start")


def anomaly_table(anomalies, n: int = 50) -> DataFrame:
    return (
        anomalies.filter("is_anomaly")
        .orderBy(F.desc("timestamp"), "event_id")
        .limit(n)
        .select(
            "timestamp", "device_id", "sensor_type", half_up(F.col("score"), 3).alias("score"),
            "severity", "drift_detected", "message",
        )
    )


def tenant_rate(df, seconds: int, step: str | None = None, *, time: str = "timestamp") -> DataFrame:
    """Events per second and tenant over a trailing window, at each step (default: one window).

    Events are counted by step first; where the window is a number of whole steps, only these counts are copied into
    the windows they belong to.
    """
    rate = lambda n: (n / float(seconds)).alias("rate")
    width = F.expr(f"INTERVAL {seconds} SECONDS")
    frame = F.window(time, step or f"{seconds} seconds")
    if step is None:
        return df.groupBy("tenant_id", frame.alias("_w")).agg(rate(F.count(F.lit(1)))).select("tenant_id", F.col("_w.end").alias("at"), "rate")
    amount, unit = step.split()
    each = int(amount) * UNITS.get(unit.rstrip("s"), 0)
    if not each or seconds % each:
        sliding = F.window(time, f"{seconds} seconds", step)
        return df.groupBy("tenant_id", sliding.alias("_w")).agg(rate(F.count(F.lit(1)))).select("tenant_id", F.col("_w.end").alias("at"), "rate")
    steps = df.groupBy("tenant_id", frame.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    first, last = F.col("_w.end"), F.col("_w.start") + width
    ends = F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step}")))
    return steps.select("tenant_id", "n", ends.alias("at")).groupBy("tenant_id", "at").agg(rate(F.sum("n"))).select("tenant_id", "at", "rate")


def tenant_totals(classified: DataFrame, anomalies: DataFrame) -> DataFrame:
    from tidemark.operators.metrics import event_counters

    return event_counters(classified, anomalies, ["tenant_id"])


def fleet_latency(tenant_metrics: DataFrame) -> DataFrame:
    """Throughput summed and latencies averaged over tenants."""
    return tenant_metrics.agg(
        F.sum("events_per_second").alias("throughput"),
        F.avg("avg_ingest_latency_ms").alias("latency_avg"),
        F.avg("p95_ingest_latency_ms").alias("latency_p95"),
        F.avg("p99_ingest_latency_ms").alias("latency_p99"),
    )
