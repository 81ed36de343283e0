"""Per-device windows and their statistics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expr import seconds_to_us, span_us
from tidemark.operators.spacing import Spacing
from tidemark.operators.split_scan import BLOCK_SECONDS, block_of, split_scan

KEY = ["tenant_id", "device_id", "sensor_type"]


def _stats() -> list[Column]:
    v = F.col("value")
    return [
        F.count(F.lit(1)).alias("count"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_pop(v).alias("std"),
    ]


def window_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Statistics per `by` and metric field; `by` identifies a window of one device.

    window_start and window_end are the first and last event time in the
    window. Each event has at least one metric, so they follow from the
    per-field times, after the aggregation has shrunk the rows.
    """
    long = df.select(*by, "timestamp", F.explode("metrics").alias("field", "value"))
    stats = long.groupBy(*by, "field").agg(
        *_stats(), F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to")
    )
    whole = W.partitionBy(*by)
    return (
        stats.withColumn("window_start", F.min("_from").over(whole))
        .withColumn("window_end", F.max("_to").over(whole))
        .drop("_from", "_to")
    )


def _edges(df: DataFrame, time: str, block_seconds: float, of: DataFrame | None = None, **aggs: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with their block of `time`, aggregates of each block of each device of `of`, the same rows if not given).

    Facts about a whole device come back to its rows by device and block, so that a device with very many rows is
    spread in that join too.
    """
    rows = df.withColumn("_block", block_of(time, block_seconds))
    from_ = rows if of is None else of.withColumn("_block", block_of(time, block_seconds))
    return rows, from_.groupBy(*KEY, "_block").agg(*[c.alias(n) for n, c in aggs.items()])


def with_window(
    df: DataFrame, size_seconds: float, *, emit_open: bool = False, block_seconds: float = BLOCK_SECONDS, of: DataFrame | None = None
) -> DataFrame:
    """Adds window_no: fixed windows counted from the device's first event.

    First and last time combine before the shuffle. The newest window is still
    open and left out unless `emit_open`. `of`: the same events before costly
    columns were added, to find first and last times without them.
    """
    size = seconds_to_us(size_seconds)
    rows, blocks = _edges(df, "timestamp", block_seconds, of, _from=F.min("timestamp"), _to=F.max("timestamp"))
    device = W.partitionBy(*KEY)
    edges = blocks.select(*KEY, "_block", F.min("_from").over(device).alias("_anchor"), F.max("_to").over(device).alias("_last"))
    number = F.floor(span_us(F.col("timestamp"), F.col("_anchor")) / size)
    newest = F.floor(span_us(F.col("_last"), F.col("_anchor")) / size)
    out = rows.join(edges, [*KEY, "_block"]).withColumn("window_no", number)
    if not emit_open:
        out = out.filter(F.col("window_no") < newest)
    return out.select(*df.columns, "window_no")


def tumbling(df: DataFrame, size_seconds: float = 10.0, *, emit_open: bool = False) -> DataFrame:
    """Window statistics of completed windows anchored at each device's first event."""
    columns = [*KEY, "timestamp", "metrics"]
    return window_stats(with_window(df.select(*columns), size_seconds, emit_open=emit_open), [*KEY, "window_no"])


def running_snapshots(
    df: DataFrame, size_seconds: float = 10.0, slide_seconds: float = 2.0, **scan
) -> DataFrame:
    """Statistics of everything in the open window, emitted at the first event
    and then at each event at least `slide_seconds` after the last emission.

    The ordered pass only finds the emitting events. An event belongs to the
    step that ends in the next emission; steps are aggregated first (with
    map-side combine) and then accumulated over the few steps of a window.
    `scan` sets block_seconds.
    """
    events = df.select("event_id", *KEY, "timestamp", "metrics")
    spacing = Spacing("timestamp", seconds_to_us(slide_seconds))
    # emissions do not depend on windows, so both readings of the pass are of bare events
    stepped = split_scan(events, KEY, ["timestamp", "event_id"], spacing, **scan)
    return _snapshots(with_window(stepped, size_seconds, emit_open=True, of=events, **scan))


def arrival_snapshots(
    df: DataFrame, size_seconds: float = 10.0, slide_seconds: float = 2.0, **scan
) -> DataFrame:
    """Snapshots as `running_snapshots`, but of events in the order in which they arrive.

    An event older than the open window is in its buffer, and so in the next
    snapshots, until the next window opens; it is never in a completed window.
    Only an event later than all before it can emit, so emissions follow from
    the latest time seen so far.
    """
    columns = ["event_id", *KEY, "timestamp", "ingested_at", "metrics"]
    placed = arrival_windows(df.select(*columns), size_seconds, **scan)
    placed = placed.drop("is_late", "window_no").withColumnRenamed("open_window", "window_no")
    spacing = Spacing("latest", seconds_to_us(slide_seconds))
    return _snapshots(split_scan(placed, KEY, ["ingested_at", "event_id"], spacing, **scan))


def _snapshots(stepped: DataFrame) -> DataFrame:
    """Statistics of the open window at each emission, from rows with window_no, kept and prev_anchor."""
    window = [*KEY, "window_no"]
    step = [*window, "prev_anchor"]
    value = F.col("value")
    parts = (
        stepped.select(*step, "timestamp", "kept", F.explode("metrics").alias("field", "value"))
        .groupBy(*step, "field")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("avg"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
            F.var_pop(value).alias("var"),
            F.min("timestamp").alias("from"),
            F.max("timestamp").alias("to"),
            F.max(F.when(F.col("kept"), F.col("timestamp"))).alias("emitted_at"),
        )
    )
    by_step = F.col("prev_anchor").asc_nulls_first()
    this_step = W.partitionBy(*step)
    up_to_step = W.partitionBy(*window).orderBy(by_step)
    steps = (
        # spread by window once and in the one order of all frames up to `filled`; every frame below is finer than that
        parts.repartition(*window)
        .sortWithinPartitions(*window, by_step, "field")
        .withColumn("emitted_at", F.max("emitted_at").over(this_step))
        .withColumn("window_start", F.min("from").over(up_to_step))
        .withColumn("window_end", F.max("to").over(up_to_step))
        .withColumn("_seen", F.collect_set("field").over(up_to_step))
        .withColumn("_here", F.collect_set("field").over(this_step))
        .withColumn("_no", F.row_number().over(this_step.orderBy("field")))
    )
    # a field of the window without a value in this step still is in the snapshot
    columns = ["field", "n", "avg", "lo", "hi", "var"]
    empty = F.transform(
        F.when(F.col("_no") == 1, F.array_except("_seen", "_here")).otherwise(F.array().cast("array<string>")),
        lambda f: F.struct(
            f.alias("field"),
            F.lit(0).cast("bigint").alias("n"),
            *[F.lit(None).cast("double").alias(c) for c in columns[2:]],
        ),
    )
    filled = steps.select(
        *step, "emitted_at", "window_start", "window_end",
        F.inline(F.concat(F.array(F.struct(*columns)), empty)),
    )
    ordered = W.partitionBy(*window, "field").orderBy(by_step)
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    # sums around the window's first mean keep the variance accurate
    off = F.col("avg") - F.col("_shift")
    return (
        filled.withColumn("_shift", F.first("avg", ignorenulls=True).over(so_far))
        .withColumn("count", F.sum("n").over(so_far))
        .withColumn("_s", F.sum(F.col("n") * off).over(so_far) / F.col("count"))
        .withColumn("_q", F.sum(F.col("n") * (F.col("var") + off * off)).over(so_far) / F.col("count"))
        .withColumn("min", F.min("lo").over(so_far))
        .withColumn("max", F.max("hi").over(so_far))
        .filter("emitted_at is not null")
        .select(
            *window, "emitted_at", "window_start", "window_end", "field", "count",
            (F.col("_shift") + F.col("_s")).alias("mean"), "min", "max",
            F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s"))).alias("std"),
        )
    )


def window_stats_aligned(
    df: DataFrame, size: str = "10 seconds", slide: str | None = None, *, watermark: str | None = None
) -> DataFrame:
    """Tumbling or hopping windows aligned to the epoch; the same call serves batch and streams.

    Streams need a watermark: rows behind it are late and dropped. In a batch, hopping windows read `df` once a hop, so
    give it as a stored table when it is costly.
    """
    if watermark is not None:
        df = df.withWatermark("timestamp", watermark)
    elif df.isStreaming:
        raise ValueError("a stream needs a watermark to close its windows")
    if slide and not df.isStreaming and (hops := _hops(size, slide)):
        # windows that begin at different hops never share a group: each hop has tasks of its own, with its groups alone
        return reduce(DataFrame.unionByName, [_aligned(df, F.window("timestamp", size, size, f"{at} seconds")) for at in hops])
    return _aligned(df, F.window("timestamp", size, slide) if slide else F.window("timestamp", size))


def _hops(size: str, slide: str) -> list[int]:
    """Seconds of each hop within a window that is a whole number of slides, both in whole seconds; else none."""
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    parts = [re.fullmatch(r"(\d+) (second|minute|hour|day)s?", x.strip()) for x in (size, slide)]
    if not all(parts):
        return []
    whole, step = (int(p[1]) * unit[p[2]] for p in parts)
    return list(range(0, whole, step)) if step and whole % step == 0 else []


def _aligned(df: DataFrame, frame: Column) -> DataFrame:
    long = df.select(*KEY, "timestamp", F.explode("metrics").alias("field", "value"))
    return (
        long.groupBy(frame.alias("w"), *KEY, "field")
        .agg(*_stats())
        .select(
            *KEY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "field", "count", "mean", "min", "max", "std",
        )
    )


def arrival_windows(df: DataFrame, size_seconds: float = 10.0, *, block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Places events in windows in arrival order and marks the late ones.

    A late event is older than the window open at its arrival: it is never
    part of a completed window. Adds window_no, open_window, is_late and
    latest, the latest event time of the device up to this arrival. The latest
    time of earlier blocks is one row a block.
    """
    size = seconds_to_us(size_seconds)
    by = ["ingested_at", "event_id"]
    first = F.min(F.struct(*by, "timestamp"))
    rows, blocks = _edges(df, "ingested_at", block_seconds, _first=first, _to=F.max("timestamp"))
    in_order = W.partitionBy(*KEY).orderBy("_block")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    edges = blocks.select(
        *KEY, "_block",
        F.first("_first.timestamp").over(in_order).alias("_anchor"),
        F.max("_to").over(earlier).alias("_before"),
    )
    so_far = W.partitionBy(*KEY, "_block").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("_here", F.max("timestamp").over(so_far)).join(edges, [*KEY, "_block"])
    placed = placed.withColumn("latest", F.greatest("_here", "_before"))
    number = lambda at: F.floor(span_us(F.col(at), F.col("_anchor")) / size)
    placed = placed.select(*df.columns, number("timestamp").alias("window_no"), number("latest").alias("open_window"), "latest")
    return placed.withColumn("is_late", F.col("window_no") < F.col("open_window"))


def completed_arrival_windows(placed: DataFrame) -> DataFrame:
    """Statistics of the windows that a later arrival has closed, from `arrival_windows`."""
    newest = placed.groupBy(*KEY).agg(F.max("open_window").alias("_newest"))
    on_time = placed.filter(~F.col("is_late")).join(newest, KEY).filter(F.col("window_no") < F.col("_newest"))
    narrow = on_time.select(*KEY, "window_no", "timestamp", "metrics").hint("rebalance", *KEY)  # tasks of one size
    return window_stats(narrow, [*KEY, "window_no"])


def time_bucket(
    df: DataFrame, interval: str, aggs: list[Column], by: list[str] | None = None, *, time: str = "timestamp"
) -> DataFrame:
    """Chart aggregation: one row per epoch-aligned interval (and `by` values)."""
    by = by or []
    return (
        df.groupBy(F.window(time, interval).alias("_w"), *by)
        .agg(*aggs)
        .select(F.col("_w.start").alias("bucket"), "*")
        .drop("_w")
    )
