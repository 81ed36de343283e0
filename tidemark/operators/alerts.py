"""Which anomalies become alerts, and what an alert says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Alerting
from tidemark.functions.expr import fixed2, literal_map, seconds_to_us
from tidemark.operators.spacing import Spacing
from tidemark.operators.split_scan import split_scan

# Severities from mild to severe, and their colours.
SEVERITIES = ("low", "medium", "high", "critical")
COLORS = {"low": "#36a64f", "medium": "#daa038", "high": "#e01e5a", "critical": "#8b0000"}


def severity_rank(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col).cast("int") - 1


def is_candidate(min_severity: str = "medium") -> Column:
    return severity_rank(F.col("severity")) >= SEVERITIES.index(min_severity)


def alert_candidates(anomalies: DataFrame, min_severity: str = "medium") -> DataFrame:
    return anomalies.filter(is_candidate(min_severity))


def cooldown(candidates: DataFrame, seconds: float = 60.0, **scan) -> DataFrame:
    """Alerts to send: per device, none sooner than `seconds` after the last one sent."""
    spacing = Spacing("timestamp", seconds_to_us(seconds))
    scanned = split_scan(candidates, ["tenant_id", "device_id"], ["timestamp", "event_id"], spacing, **scan)
    return scanned.filter("kept").drop("kept", "prev_anchor")


def _field(title: str, value: Column) -> Column:
    return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(True).alias("short"))


def top_signal() -> Column:
    """The largest entry of methods as name=0.00; the first one listed wins a tie."""
    entries = F.map_entries("methods")
    best = F.array_max(F.map_values("methods"))
    first = F.get(F.filter(entries, lambda e: e["value"] == best), F.lit(0))
    return F.concat(first["key"], F.lit("="), fixed2(first["value"]))


def alert_payload(alerts: DataFrame, footer: str = "tidemark") -> DataFrame:
    """Adds payload: the alert as chat-webhook JSON."""
    fields = F.array_compact(
        F.array(
            _field("Device", F.col("device_id")),
            _field("Sensor Type", F.col("sensor_type")),
            _field("Score", fixed2(F.col("score"))),
            _field("Severity", F.upper("severity")),
            F.when(F.col("drift_detected"), _field("Drift", F.lit("Detected"))),
            F.when(F.size("methods") > 0, _field("Top Signal", top_signal())),
        )
    )
    color = F.try_element_at(literal_map({k: F.lit(v) for k, v in COLORS.items()}), F.col("severity"))
    attachment = F.struct(
        color.alias("color"),
        F.concat(F.lit("Telemetry Anomaly — "), F.col("device_id")).alias("title"),
        F.when(F.length("message") > 0, F.col("message")).otherwise("Anomaly detected").alias("text"),
        fields.alias("fields"),
        F.lit(footer).alias("footer"),
        F.floor(F.unix_micros("timestamp") / 1_000_000).alias("ts"),
    )
    return alerts.withColumn("payload", F.to_json(F.struct(F.array(attachment).alias("attachments"))))


def alerts(anomalies: DataFrame, cfg: Alerting = Alerting(), **scan) -> DataFrame:
    return alert_payload(cooldown(alert_candidates(anomalies, cfg.min_severity), cfg.cooldown_seconds, **scan))
