"""Queries behind the API and the device pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import METHODS
from tidemark.functions.expr import span_us
from tidemark.operators.enrich import for_tenant
from tidemark.operators.metrics import newest
from tidemark.sinks.batches import BatchTable


def _recent(df, tenant, device, order: list[str], limit: int) -> DataFrame:
    df = for_tenant(df, tenant)
    if device is not None:
        df = df.filter(F.col("device_id") == device)
    return df.orderBy(F.desc(order[0]), *order[1:]).limit(limit)


def recent_events(df: DataFrame, limit: int = 100, tenant: str | None = None, device: str | None = None) -> DataFrame:
    """Newest events first, 1000 at most as the interface has it; a top-k, not a sort of the table."""
    return _recent(df, tenant, device, ["timestamp", "event_id"], min(limit, 1000))


def last_arrivals(df: DataFrame, limit: int = 100, tenant: str | None = None, device: str | None = None) -> DataFrame:
    """The last events in arrival order, oldest of them first."""
    df = for_tenant(df, tenant)
    if device is not None:
        df = df.filter(F.col("device_id") == device)
    return newest(df, [], limit, ["ingested_at", "event_id"]).orderBy("ingested_at", "event_id")


def recent_anomalies(df: DataFrame, limit: int = 50, tenant: str | None = None, device: str | None = None) -> DataFrame:
    """Newest anomalies first, 500 at most as the interface has it."""
    return _recent(df, tenant, device, ["timestamp", "event_id"], min(limit, 500))


def recent_window_stats(
    df: DataFrame, limit: int = 100, tenant: str | None = None, device: str | None = None
) -> DataFrame:
    """Newest window statistics first, 500 at most as the interface has it."""
    order = ["window_end", "tenant_id", "device_id", "sensor_type", "window_start", "field"]
    return _recent(df, tenant, device, order, min(limit, 500))


def newest_first(
    table: BatchTable, query: Callable[..., DataFrame], limit: int, tenant: str | None = None, device: str | None = None, *, span_days: int = 0
) -> DataFrame:
    """`recent_events`, `recent_anomalies` or `recent_window_stats` (as `query`) of a stored table, from its newest dates.

    Dates are opened from the newest on, twice as many with each try, until `limit` rows are there: rows of an older
    date cannot be newer. Which dates there are the manifests tell. span_days: days that a row's sort time may lie
    behind its date, for windows that begin on one day and end on another.
    """
    tenants = None if tenant is None else [tenant]
    dates, take = table.dates(tenants), 1
    while True:
        last = dates[min(take, len(dates)) - 1] if dates else None
        found = query(table.read(since=last, tenants=tenants), limit, tenant, device)
        if take >= len(dates) or found.count() >= limit:
            break
        take *= 2
    if not span_days or take >= len(dates):
        return found
    first = (dt.date.fromisoformat(last) - dt.timedelta(days=span_days)).isoformat()
    return query(table.read(since=first, tenants=tenants), limit, tenant, device)


def device_summary(df: DataFrame, tenant: str | None = None) -> DataFrame:
    """Per device: type, tenant, event count, last time seen and the metrics reported then."""
    latest = F.struct("timestamp", "event_id")
    return for_tenant(df, tenant).groupBy("device_id").agg(
        F.max("sensor_type").alias("sensor_type"),
        F.max("tenant_id").alias("tenant_id"),
        F.count(F.lit(1)).alias("event_count"),
        F.max("timestamp").alias("last_seen"),
        F.max_by("metrics", latest).alias("last_metrics"),
    )


def list_devices(df: DataFrame, tenant: str | None = None, limit: int = 200) -> DataFrame:
    """Devices seen last first, 500 at most as the interface has it."""
    return device_summary(df, tenant).orderBy(F.desc("last_seen"), "device_id").limit(min(limit, 500))


def device_health(devices: DataFrame, as_of: Column) -> DataFrame:
    """Adds health: online under a minute of silence, stale under five, else offline."""
    age = span_us(as_of, F.col("last_seen"))
    health = F.when(age < 60_000_000, "online").when(age < 300_000_000, "stale").otherwise("offline")
    return devices.withColumn("health", health)


def search_devices(devices: DataFrame, query: str = "", sensor_type: str | None = None) -> DataFrame:
    """Case-insensitive match of the query inside id or type; optionally one sensor type."""
    if query:
        q = F.lower(F.lit(query))
        devices = devices.filter(F.lower("device_id").contains(q) | F.lower("sensor_type").contains(q))
    if sensor_type:
        devices = devices.filter(F.col("sensor_type") == sensor_type)
    return devices


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def tenant_list(df: DataFrame, default: str = "default") -> DataFrame:
    """Distinct tenants in order, the default one first."""
    return df.select("tenant_id").distinct().orderBy(F.col("tenant_id") != default, "tenant_id")


def severity_counts(anomalies: DataFrame, severity: str | None = None) -> DataFrame:
    if severity is not None:
        anomalies = anomalies.filter(F.col("severity") == severity)
    return anomalies.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def method_breakdown(anomalies: DataFrame, *, literal_prefixes: bool = False) -> DataFrame:
    """Rows (event_id, name, score) of the scoring methods without their details.

    Details are the names starting with if_, ae_ or rule_. rule_based is a
    method and stays, unless `literal_prefixes` applies the prefixes as they are.
    """
    name = F.col("name")
    detail = name.startswith("if_") | name.startswith("ae_") | name.startswith("rule_")
    keep = ~detail if literal_prefixes else ~detail | name.isin(*METHODS)
    return anomalies.select("event_id", F.explode("methods").alias("name", "score")).filter(keep)


def metric_series(df: DataFrame, fields: list[str]) -> DataFrame:
    """Events in time order with one column per field."""
    return df.select(
        "timestamp", "event_id", *[F.try_element_at("metrics", F.lit(f)).alias(f) for f in fields]
    ).orderBy("timestamp", "event_id")


def sparkline(history: DataFrame, columns: list[str], n: int = 24, *, time: str = "timestamp") -> DataFrame:
    """One row with the last n values of each column, oldest first."""
    last = history.orderBy(F.desc(time)).limit(n).select(time, *columns)
    rows = F.sort_array(F.collect_list(F.struct(time, *columns)))
    return last.agg(rows.alias("_r")).select(*[F.col("_r")[c].alias(c) for c in columns])


def dashboard_snapshot(
    metrics: DataFrame, events: DataFrame, anomalies: DataFrame, tenant: str | None = None
) -> DataFrame:
    """One row: current metrics, the 200 newest events and the 50 newest anomalies."""

    def newest_first(df, name):
        rows = F.collect_list(F.struct(F.col("timestamp").alias("_t"), F.struct(*df.columns).alias("r")))
        return df.agg(F.transform(F.sort_array(rows, asc=False), lambda x: x["r"]).alias(name))

    now = for_tenant(metrics, tenant)
    now = now.agg(F.collect_list(F.struct(*now.columns)).alias("metrics"))  # one row per tenant
    e = recent_events(events, 200, tenant).select(
        "event_id", "tenant_id", "device_id", "sensor_type", "timestamp", F.to_json("metrics").alias("metrics")
    )
    a = recent_anomalies(anomalies, 50, tenant).select(
        "event_id", "tenant_id", "device_id", "sensor_type", "timestamp", "score", "is_anomaly", "severity", "message"
    )
    return (
        now.join(F.broadcast(newest_first(e, "events"))).join(F.broadcast(newest_first(a, "anomalies")))  # one row each
    )
