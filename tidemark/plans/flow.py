"""The whole way from raw events to stored tables, as composable steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.config import DEFAULT_CATALOG, Catalog, Settings
from tidemark.operators.alerts import alerts
from tidemark.operators.dedup import mark_duplicates
from tidemark.operators.enrich import enrich, resolve_tenant
from tidemark.operators.scoring import detect
from tidemark.operators.validate import classify, validate
from tidemark.operators.windows import running_snapshots, tumbling


@dataclass
class Results:
    classified: DataFrame
    events: DataFrame
    window_stats: DataFrame
    snapshots: DataFrame
    anomalies: DataFrame
    alerts: DataFrame


def check(raw: DataFrame, cfg: Settings = Settings(), catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Validated, deduplicated and classified events; nothing is dropped yet."""
    marked = mark_duplicates(validate(raw, catalog), cfg.dedup_window_seconds, deliveries=raw)
    return classify(marked, cfg.drop_invalid)


def clean(raw: DataFrame, cfg: Settings = Settings(), catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """The valid events, enriched."""
    valid = check(raw, cfg, catalog).filter("is_valid")
    return enrich(valid, catalog, environment=cfg.environment, tenancy=cfg.tenancy)


def process(raw: DataFrame, cfg: Settings = Settings(), catalog: Catalog = DEFAULT_CATALOG, store=None) -> Results:
    """All results of a batch. `store(events) -> DataFrame` may write the clean
    events and hand back the table, so that later steps read it instead of
    cleaning again."""
    classified = check(raw, cfg, catalog)
    events = enrich(
        classified.filter("is_valid"), catalog, environment=cfg.environment, tenancy=cfg.tenancy
    )
    if store is not None:
        events = store(events)
    anomalies = detect(events, cfg.detection, catalog)
    return Results(
        classified,
        events,
        tumbling(events, cfg.window_size_seconds),
        running_snapshots(events, cfg.window_size_seconds, cfg.slide_interval_seconds),
        anomalies,
        alerts(anomalies, cfg.alerting),
    )


def with_tenant(classified: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Classified events with their resolved tenant, for counters per tenant."""
    return resolve_tenant(classified, cfg.tenancy)
