"""Streaming operators and their wiring."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.config import DEFAULT_CATALOG, Alerting, Catalog, Detection, Drift, Ewma, Settings
from tidemark.functions.expr import seconds_to_us
from tidemark.operators.alerts import alert_candidates, alert_payload, is_candidate
from tidemark.operators.dedup import dedup_key
from tidemark.operators.detectors import AdwinDrift, EwmaScore, OnlineAutoencoder
from tidemark.operators.enrich import enrich, metric_vector, resolve_tenant
from tidemark.operators.scan import OpenWindow
from tidemark.operators.spacing import Spacing
from tidemark.operators.scoring import DEVICE, ORDER, SENSOR, _trees, ensemble, primary_metric, with_rules
from tidemark.operators.validate import has_errors, validate
from tidemark.sinks.batches import BatchTable, LatestTable
from tidemark.streaming.counters import observe_checked, observe_found, observe_kept
from tidemark.streaming.keyed import bucket_spacing, keyed_scan, keyed_steps
from tidemark.streaming.windows import window_stream

# How long keyed state outlives the last event of a key, by default.
STATE_TTL_SECONDS = 7 * 86400.0


def dedup_stream(df: DataFrame, window_seconds: float = 5.0, delay_seconds: float = 60.0, buckets: int = 128) -> DataFrame:
    """Kept deliveries, exact: the greedy rule, for buckets of event keys at a time.

    Nearly every event has a key of its own, so keys are dealt into buckets, each one state; a hot device is spread
    over all of them. A key is forgotten once the window and `delay_seconds`, by which deliveries may come out of
    order, lie behind the newest one.
    """
    narrow = df.withColumn("dedup_key", dedup_key())
    spacing = Spacing("ingested_at", seconds_to_us(window_seconds), strict=True)
    keep = window_seconds + delay_seconds
    return bucket_spacing(narrow, "dedup_key", ["ingested_at", "event_id"], spacing, keep_seconds=keep, buckets=buckets).drop("dedup_key")


def dedup_stream_approx(df: DataFrame, window_seconds: float = 5.0) -> DataFrame:
    """All in the JVM: repeats within the watermark delay of arrival time are dropped."""
    keyed = df.withColumn("dedup_key", dedup_key()).withWatermark("ingested_at", f"{window_seconds} seconds")
    return keyed.dropDuplicatesWithinWatermark(["dedup_key"]).drop("dedup_key")


def ewma_stream(df: DataFrame, cfg: Ewma = Ewma(), ttl_seconds: float | None = STATE_TTL_SECONDS) -> DataFrame:
    return keyed_scan(df, DEVICE, ORDER, [EwmaScore(cfg)], ttl_seconds=ttl_seconds)


def drift_stream(df: DataFrame, cfg: Drift = Drift(), ttl_seconds: float | None = STATE_TTL_SECONDS) -> DataFrame:
    df = df.withColumn("primary", primary_metric())
    return keyed_scan(df, DEVICE, ORDER, [AdwinDrift(cfg)], ttl_seconds=ttl_seconds).drop("primary")


def autoencoder_stream(df: DataFrame, cfg, catalog=DEFAULT_CATALOG, models=None, ttl_seconds: float | None = STATE_TTL_SECONDS):
    df = df.withColumn("vector", metric_vector(catalog))
    return keyed_scan(df, SENSOR, ORDER, [OnlineAutoencoder(cfg, models)], ttl_seconds=ttl_seconds).drop("vector")


def arrival_windows_stream(df: DataFrame, size_seconds: float, ttl_seconds: float | None = STATE_TTL_SECONDS) -> DataFrame:
    """Events with their window in arrival order; late ones are marked."""
    window = OpenWindow("timestamp", seconds_to_us(size_seconds))
    placed = keyed_scan(df, SENSOR, ["ingested_at", "event_id"], [window], ttl_seconds=ttl_seconds)
    return placed.withColumn("is_late", F.col("window_no") < F.col("open_window"))


def cooldown_stream(
    anomalies: DataFrame, cfg: Alerting = Alerting(), ttl_seconds: float | None = STATE_TTL_SECONDS
) -> DataFrame:
    """Alerts with payload."""
    return marked_alerts(cooldown_marks(alert_candidates(anomalies, cfg.min_severity), cfg, ttl_seconds))


MARKS = ["_candidate", "kept", "prev_anchor"]


def cooldown_marks(anomalies: DataFrame, cfg: Alerting, ttl_seconds: float | None) -> DataFrame:
    """All anomalies, with MARKS: those that are alerts are kept."""
    spacing = Spacing("timestamp", seconds_to_us(cfg.cooldown_seconds))
    marked = anomalies.withColumn("_candidate", F.coalesce(is_candidate(cfg.min_severity), F.lit(False)))
    return keyed_steps(marked, ORDER, [(DEVICE, [spacing])], ttl_seconds=ttl_seconds, where="_candidate")


def marked_alerts(marked: DataFrame) -> DataFrame:
    return alert_payload(marked.filter("kept").drop(*MARKS))


def detect_stream(
    df: DataFrame,
    cfg: Detection = Detection(),
    catalog: Catalog = DEFAULT_CATALOG,
    models=None,
    ttl_seconds: float | None = STATE_TTL_SECONDS,
) -> DataFrame:
    """Anomaly rows of a stream of enriched events: models of a device, then models of its sensor types, as `detect` has them."""
    df = df.select("event_id", *SENSOR, "timestamp", "metrics")
    df = df.withColumns({"vector": metric_vector(catalog), "primary": primary_metric()})
    by_device = [EwmaScore(cfg.ewma)] + ([AdwinDrift(cfg.drift)] if cfg.drift.enabled else [])
    by_sensor = [_trees(cfg.trees, catalog)]
    if cfg.autoencoder.enabled:
        by_sensor.append(OnlineAutoencoder(cfg.autoencoder, models))
    df = keyed_steps(df, ORDER, [(DEVICE, by_device), (SENSOR, by_sensor)], ttl_seconds=ttl_seconds)
    found = ensemble(with_rules(df, catalog), cfg)
    return found if cfg.enabled else found.filter(F.lit(False))


def clean_stream(
    raw: DataFrame,
    cfg: Settings = Settings(),
    catalog: Catalog = DEFAULT_CATALOG,
    *,
    exact_dedup: bool = True,
    delay_seconds: float = 60.0,
    observe: bool = False,
) -> DataFrame:
    """Valid, deduplicated and enriched events of a stream of sensor events; `observe` for `LiveCounters`."""
    checked = validate(raw, catalog)
    if observe:
        checked = observe_checked(checked)
    # an invalid event takes part in deduplication, as in a batch
    if exact_dedup:
        kept = dedup_stream(checked, cfg.dedup_window_seconds, delay_seconds)
    else:
        kept = dedup_stream_approx(checked, cfg.dedup_window_seconds)
    if observe:
        kept = observe_kept(kept)
    if cfg.drop_invalid:
        kept = kept.filter(~has_errors())
    return enrich(kept, catalog, environment=cfg.environment, tenancy=cfg.tenancy)


def clean_columns(raw: DataFrame, cfg: Settings, catalog: Catalog, columns: list[str]) -> DataFrame:
    """Some columns of `clean_stream`, of which enriching adds none but the tenant; no others are shuffled."""
    needed = dict.fromkeys([*columns, "device_id", "timestamp", "metrics", "ingested_at", "event_id"])
    checked = resolve_tenant(validate(raw, catalog), cfg.tenancy).select(*needed, has_errors().alias("_faulty"))
    kept = dedup_stream(checked, cfg.dedup_window_seconds)
    return (kept.filter("NOT _faulty") if cfg.drop_invalid else kept).select(*columns)


def trigger_options(interval_seconds: float | None = None) -> dict:
    """How often micro-batches start: a fixed interval, or once over what is there."""
    return {"availableNow": True} if interval_seconds is None else {"processingTime": f"{interval_seconds} seconds"}


def started(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a stream whose state has at most two partitions a core.

    Every micro-batch opens each partition of the state in a task of its own, however few rows it has, and the many
    small partitions that suit a batch join cost more than the rows. The number is fixed by the first start: a later
    one takes it from the checkpoint.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def start_parquet(df: DataFrame, path: str, checkpoint: str, interval_seconds: float | None = None) -> StreamingQuery:
    return started(
        df.sparkSession,
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger_options(interval_seconds)),
    )


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def start_table(
    rows: DataFrame,
    table: BatchTable,
    checkpoint: str,
    *,
    latest: LatestTable | None = None,
    stream: str | None = None,
    interval_seconds: float | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Writes each micro-batch to a table, as a batch that counts once, so a repeated micro-batch changes nothing.

    stream: names the micro-batches together with their number; by default it follows from the checkpoint, whose
    numbers they are. `latest` is refreshed, and `on_batch` called, with the same rows.
    """
    return start_tables(rows, [(table, lambda batch: batch, latest)], checkpoint, stream=stream, interval_seconds=interval_seconds, on_batch=on_batch)


def start_tables(
    rows: DataFrame,
    parts: list[tuple[BatchTable, Callable[[DataFrame], DataFrame], LatestTable | None]],
    checkpoint: str,
    *,
    stream: str | None = None,
    interval_seconds: float | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """`start_table` for several tables: each takes what its function makes of a micro-batch, which is worked out once.

    It is cached only where more than one reads it: a table writes in one pass, and `LatestTable` takes what was written.
    """
    name = stream or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        which = f"{name}-{number:012d}"
        left = [table for table, _, _ in parts if not table.committed(which)]
        shared = len(left) + (on_batch is not None) > 1
        if shared:
            batch = batch.persist()
        try:
            if not left:
                drain(batch)  # the state behind the rows has to move on with them
            for table, part, latest in parts:
                table.write(which, part(batch))
                if latest is not None and not latest.committed(which):
                    stored = table.stored(which)
                    latest.write(which, part(batch).limit(0) if stored is None else stored)
            if on_batch is not None:
                on_batch(batch, number)
        finally:
            if shared:
                batch.unpersist()

    return started(
        rows.sparkSession,
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(interval_seconds)),
    )


def start_fan_out(
    events: DataFrame,
    root: str,
    checkpoint: str,
    *,
    interval_seconds: float | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Writes each micro-batch of clean events to the events table, where an event is stored once."""
    table = flow_tables(events.sparkSession, root)["events"]
    return start_table(events, table, checkpoint, interval_seconds=interval_seconds, on_batch=on_batch)


def flow_tables(spark: SparkSession, root: str) -> dict[str, BatchTable]:
    """The tables that `start_flow` fills."""
    return {
        "events": BatchTable(spark, f"{root}/events", key=("event_id", "timestamp")),
        "window_stats": BatchTable(spark, f"{root}/window_stats", time="window_start"),
        "anomalies": BatchTable(spark, f"{root}/anomalies", key=("event_id", "timestamp")),
        "alerts": BatchTable(spark, f"{root}/alerts", key=("event_id", "timestamp")),
    }


def snapshot_tables(spark: SparkSession, root: str) -> dict[str, LatestTable]:
    """What a dashboard shows, kept fresh by `start_flow`: the newest 200 events and 50 anomalies of each tenant."""
    newest = lambda name, n: LatestTable(spark, f"{root}/latest_{name}", n=n, order=("timestamp", "event_id"), key=("event_id", "timestamp"))
    return {"events": newest("events", 200), "anomalies": newest("anomalies", 50)}


def start_flow(
    raw: DataFrame,
    root: str,
    state: str,
    *,
    cfg: Settings = Settings(),
    catalog: Catalog = DEFAULT_CATALOG,
    models=None,
    stream: str | None = None,
    interval_seconds: float | None = None,
) -> dict[str, StreamingQuery]:
    """Everything from a source of sensor events to tables: clean events, window statistics and snapshots in order of
    arrival, anomalies, and alerts; and the tables of `snapshot_tables`, refreshed with every micro-batch. What it
    observes, `LiveCounters` counts.

    Each query has its own checkpoint under `state` and its own reading of the source, so that they fail and recover
    on their own; anomalies and alerts, which are some of them, share one. `stream` is as in `start_table`.
    """
    ttl = None if interval_seconds is None else STATE_TTL_SECONDS
    clean = clean_columns(raw, cfg, catalog, ["event_id", *SENSOR, "timestamp", "ingested_at", "metrics"])
    found = observe_found(detect_stream(clean, cfg.detection, catalog, models, ttl))
    tables, latest = flow_tables(raw.sparkSession, root), snapshot_tables(raw.sparkSession, root)
    whole = lambda batch: batch
    rows = {
        ("events",): (clean_stream(raw, cfg, catalog, observe=True), [whole]),
        ("window_stats",): (window_stream(clean, cfg.window_size_seconds, cfg.slide_interval_seconds, order="arrival"), [whole]),
        ("anomalies", "alerts"): (cooldown_marks(found, cfg.alerting, ttl), [lambda batch: batch.drop(*MARKS), marked_alerts]),
    }
    queries = {}
    for names, (df, picks) in rows.items():
        parts = [(tables[n], pick, latest.get(n)) for n, pick in zip(names, picks, strict=True)]
        query = start_tables(df, parts, f"{state}/{names[0]}", stream=stream, interval_seconds=interval_seconds)
        queries |= dict.fromkeys(names, query)
    return queries


def start_alerts(
    anomalies: DataFrame,
    checkpoint: str,
    send: Callable[[DataFrame], None],
    cfg: Alerting = Alerting(),
    *,
    interval_seconds: float | None = None,
) -> StreamingQuery:
    """Sends alerts through `send`, which gets a DataFrame with the payload column per micro-batch."""
    return started(
        anomalies.sparkSession,
        cooldown_stream(anomalies, cfg, None if interval_seconds is None else STATE_TTL_SECONDS)
        .writeStream.foreachBatch(lambda batch, _: send(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(interval_seconds)),
    )

