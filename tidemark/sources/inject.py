"""Labelled anomalies written into a table of normal events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import DEFAULT_CATALOG, AnomalyPattern, Catalog, MetricField
from tidemark.functions.expr import by_sensor_type

def _draw(*parts) -> Column:
    """A number in [0, 1) that depends on the event only, not on partitioning."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _changed(p: AnomalyPattern, d: MetricField, value: Column, drift: Column) -> Column:
    if p.type == "spike" and p.multiplier:
        return F.least(F.lit(d.max), value * p.multiplier)
    if p.type == "drift" and p.slope:
        return F.least(F.lit(d.max), value + drift)
    if p.type == "flatline":
        return F.lit(d.baseline)
    return value


def _apply(p: AnomalyPattern, d: MetricField) -> Column:
    drift = F.col("_nth") * (p.slope or 0.0)
    return F.transform_values("metrics", lambda k, v: F.when(k == p.field, _changed(p, d, v, drift)).otherwise(v))


def inject_anomalies(
    df: DataFrame, catalog: Catalog = DEFAULT_CATALOG, rate: float = 0.02, seed: int = 42
) -> DataFrame:
    """Picks events at `rate` and applies one pattern of their sensor type.

    spike multiplies a metric up to its maximum, flatline sets the baseline,
    and drift adds a slope once more with each chosen event of a device. Sets
    is_anomaly and anomaly_label ("type:field") on the picked events.
    """
    counts = by_sensor_type(catalog, lambda t: F.lit(len(t.anomaly_patterns)))
    number = F.floor(_draw(F.col("event_id"), F.lit(seed + 1)) * counts)
    picked = (_draw(F.col("event_id"), F.lit(seed)) < rate) & (F.coalesce(counts, F.lit(0)) > 0)
    df = df.withColumn("_pick", F.when(picked, number))

    def label_of(t):
        out = F.lit(None).cast("string")
        for i, p in enumerate(t.anomaly_patterns):
            out = F.when(F.col("_pick") == i, f"{p.type}:{p.field}").otherwise(out)
        return out

    df = df.withColumn("_label", by_sensor_type(catalog, label_of))
    # the drift offset is the running count of drifts, over picked drift events only
    drifting = df.filter(F.col("_label").startswith("drift:"))
    so_far = W.partitionBy("device_id", "_label").orderBy("timestamp", "event_id")
    nth = drifting.select("event_id", F.row_number().over(so_far).alias("_nth"))
    df = df.join(nth, "event_id", "left")

    def metrics_of(t):
        out = F.col("metrics")
        for i, p in enumerate(t.anomaly_patterns):
            out = F.when(F.col("_pick") == i, _apply(p, t.fields[p.field])).otherwise(out)
        return out

    hit = F.col("_pick").isNotNull()
    return df.withColumns(
        {
            "metrics": F.when(hit, by_sensor_type(catalog, metrics_of)).otherwise(F.col("metrics")),
            "is_anomaly": hit,
            "anomaly_label": F.when(hit, F.col("_label")),
        }
    ).drop("_pick", "_label", "_nth")
