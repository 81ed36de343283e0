"""Counters, latency statistics and throughput of a processed stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expr import US, seconds_to_us, span_us


def counters() -> list[Column]:
    """Aggregates over classified events (see `classify`)."""
    return [
        F.count(F.lit(1)).alias("events_ingested"),
        F.count_if("is_valid").alias("events_valid"),
        F.count_if("is_invalid").alias("events_invalid"),
        F.count_if("is_deduped").alias("events_deduped"),
    ]


def event_counters(classified: DataFrame, anomalies: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The five counters. Every emitted anomaly row counts, drift-only and warning rows too."""
    by = by or []
    events = classified.groupBy(*by).agg(*counters())
    found = anomalies.groupBy(*by).agg(F.count(F.lit(1)).alias("anomalies_detected"))
    if by:
        both = events.join(found, by, "left")
    else:
        both = events.join(F.broadcast(found))  # one row each
    return both.withColumn("anomalies_detected", F.coalesce("anomalies_detected", F.lit(0).cast("bigint")))


def newest(df: DataFrame, by: list[str], n: int, order: list[str]) -> DataFrame:
    """The last n rows per group. Tasks keep their own last n before the shuffle."""
    if not by:
        return df.orderBy(*[F.desc(c) for c in order]).limit(n)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latency_stats(
    df: DataFrame,
    value: str = "ingest_latency_ms",
    percentiles: tuple[float, ...] = (50, 95, 99),
    by: list[str] | None = None,
    *,
    last: int | None = None,
    order: tuple[str, ...] = ("ingested_at", "event_id"),
) -> DataFrame:
    """Mean and nearest-rank percentiles, sorted[min(int(n * p / 100), n - 1)], of all samples or of the last ones."""
    by = by or []
    if last is not None:
        sample = newest(df.select(*by, value, *order).dropna(subset=[value]), by, last, list(order))
    else:
        sample = df.select(*by, value)
    return nearest_rank(sample, value, percentiles, by)


def _bin(v: Column) -> Column:
    """A bin of a number that never falls as the number grows: 256 to each power of two, so under 2**20 in all."""
    v = v.cast("double")
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1025.0)) + 1100) * 256).cast("bigint")
    return F.when(F.isnan(v), F.lit(1 << 20)).when(v == 0, F.lit(0)).when(v < 0, -size).otherwise(size).cast("bigint")


def _at_ranks(df: DataFrame, value: str, by: list[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """n, mean and the values at the given ranks (from 0) as r0, r1, ... of each group, exact.

    A histogram per group finds the bins that hold the ranks; then only values in those bins are ordered, so no task
    holds or orders a group.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("_bin", _bin(F.col("v")))
    )
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    bins = counts.groupBy(*by, "_bin").agg(F.sum("c").alias("_c"), F.sum(F.col("v") * F.col("c")).alias("_sum"))
    up_to = group.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = (
        bins.withColumn("_before", F.sum("_c").over(up_to) - F.col("_c"))
        .withColumn("n", F.sum("_c").over(group))
        .withColumn("_sum", F.sum("_sum").over(group))
    )
    wanted = ranks(F.col("n"))
    inside = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")) for r in wanted]
    hits = bins.filter(F.exists(F.array(*inside), lambda x: x))
    hits = hits.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bin").alias("_at"), "_before", "n", "_sum")
    same = F.col("_bin") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    within = W.partitionBy(*by, "_bin").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.join(hits, same).withColumn("hi", F.col("_before") + F.sum("c").over(within))
    lo = F.col("hi") - F.col("c")
    picks = [F.max(F.when((lo <= r) & (r < F.col("hi")), F.col("v"))).alias(f"r{i}") for i, r in enumerate(wanted)]
    mean = F.max("_sum") / F.max("n")
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), mean.alias("mean"), *picks)


def nearest_rank(df: DataFrame, value: str, percentiles: tuple[float, ...], by: list[str]) -> DataFrame:
    """samples, mean and the percentiles of each group."""
    ranks = lambda n: [F.least(F.floor(n * float(p) / 100.0), n - 1) for p in percentiles]
    found = _at_ranks(df, value, by, ranks)
    return found.select(*by, F.col("n").alias("samples"), "mean", *[F.col(f"r{i}").alias(f"p{p:g}") for i, p in enumerate(percentiles)])


def interpolated(df: DataFrame, value: str, fraction: float, by: list[str], name: str) -> DataFrame:
    """Linearly interpolated quantile per group (percentile_cont), plus the mean, exact."""
    at = lambda n: (n - 1) * float(fraction)
    found = _at_ranks(df, value, by, lambda n: [F.floor(at(n)), F.ceil(at(n))])
    between = F.col("r0") + (F.col("r1") - F.col("r0")) * (at(F.col("n")) - F.floor(at(F.col("n"))))
    return found.select(*by, "mean", between.alias(name))


SKETCH = ("bin", "n", "total", "low", "high")


def quantile_sketch(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A sketch of the values of each group, as rows: count, sum, least and greatest value of each bin.

    Bins are a 256th of a power of two, so a quantile is off by less than 0.28 percent. Sketches of parts add up:
    `merged_sketch` of any of them, in any order, is the sketch of the whole.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    return rows.groupBy(*by, _bin(F.col("_v")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )


def merged_sketch(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def sketch_quantiles(sketch: DataFrame, fractions: tuple[float, ...], by: list[str]) -> DataFrame:
    """samples, mean and the quantiles (0.95 as p95) of each group, from a sketch with one row a bin: a group has 2^20 bins at most."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    up_to = group.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = sketch.withColumn("_hi", F.sum("n").over(up_to)).withColumn("_all", F.sum("n").over(group))
    rank = lambda f: F.floor((F.col("_all") - 1) * float(f))
    hit = lambda f: (F.col("_hi") - F.col("n") <= rank(f)) & (rank(f) < F.col("_hi"))
    picks = [F.max(F.when(hit(f), F.col("total") / F.col("n"))).alias(f"p{f * 100:g}") for f in fractions]
    return ranked.groupBy(*by).agg(F.sum("n").alias("samples"), (F.sum("total") / F.sum("n")).alias("mean"), *picks)


def bucket_label(bound: float) -> str:
    return f"<={bound:g}"


def latency_histogram(
    df: DataFrame, buckets: tuple[float, ...], value: str = "ingest_latency_ms", by: list[str] | None = None
) -> DataFrame:
    """Rows (bucket, count): each value counts in the first bucket it fits; empty buckets are listed."""
    by = by or []
    v = F.col(value)
    counts, lower = [], F.lit(True)
    for b in buckets:
        counts.append(F.count_if(lower & (v <= b)).alias(bucket_label(b)))
        lower = v > b
    counts.append(F.count_if(v > max(buckets)).alias(">max"))
    labels = [bucket_label(b) for b in buckets] + [">max"]
    wide = df.groupBy(*by).agg(*counts)
    return wide.unpivot(by, labels, "bucket", "count") if by else wide.unpivot([], labels, "bucket", "count")


def histogram_map(buckets: tuple[float, ...], value: str) -> Column:
    """The same histogram as one map column, for an aggregation that is already grouped."""
    v = F.col(value)
    entries, lower = [], F.lit(True)
    for b in buckets:
        entries += [F.lit(bucket_label(b)), F.count_if(lower & (v <= b))]
        lower = v > b
    return F.create_map(*entries, F.lit(">max"), F.count_if(v > max(buckets)))


# Bounds of the cumulative histogram, in seconds.
CUMULATIVE_BOUNDS_S = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def cumulative_histogram(
    df: DataFrame, value_ms: str = "ingest_latency_ms", by: list[str] | None = None
) -> DataFrame:
    """Rows (le, count) with counts of values up to each bound and to +Inf, and the total of all values."""
    by = by or []
    s = F.col(value_ms) / 1000.0
    names = [f"{b:g}" for b in CUMULATIVE_BOUNDS_S] + ["+Inf"]
    counts = [F.count_if(s <= b).alias(n) for b, n in zip(CUMULATIVE_BOUNDS_S, names)]
    wide = df.groupBy(*by).agg(*counts, F.count(value_ms).alias("+Inf"), F.sum(s).alias("sum"))
    return wide.unpivot([*by, "sum"], [F.col(f"`{n}`") for n in names], "le", "count")


def throughput(
    df: DataFrame, seconds: float = 5.0, by: list[str] | None = None, *, time: str = "ingested_at"
) -> DataFrame:
    """Events per second over the trailing window that ends at each group's last event.

    n / span of the times in it; n / window for a single event; n when all
    coincide. Needs only the last time per group and then a few late rows.
    """
    by = by or []
    last = df.groupBy(*by).agg(F.max(time).alias("_last"))
    rows = df.select(*by, time)
    joined = rows.join(last, by) if by else rows.join(F.broadcast(last))  # one row
    recent = joined.filter(span_us(F.col("_last"), F.col(time)) <= seconds_to_us(seconds))
    n, span = F.col("_n").cast("double"), F.col("_span") / float(US)
    return (
        recent.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), span_us(F.max(time), F.min(time)).alias("_span"))
        .select(
            *by,
            F.when(n < 2, n / max(seconds, 1e-6)).when(span <= 0, n).otherwise(n / span).alias("events_per_second"),
        )
    )


def tenant_metrics(
    classified: DataFrame,
    anomalies: DataFrame,
    *,
    throughput_seconds: float = 5.0,
    buckets: tuple[float, ...] = (),
    last: int | None = None,
) -> DataFrame:
    """One row per tenant: counters, ingest latency of valid events (all, or the last ones), throughput (and a histogram map)."""
    by = ["tenant_id"]
    valid = classified.filter("is_valid")
    latency = latency_stats(valid, percentiles=(95, 99), by=by, last=last).select(
        "tenant_id",
        F.col("mean").alias("avg_ingest_latency_ms"),
        F.col("p95").alias("p95_ingest_latency_ms"),
        F.col("p99").alias("p99_ingest_latency_ms"),
    )
    out = event_counters(classified, anomalies, by).join(latency, by, "left")
    out = out.join(throughput(classified, throughput_seconds, by), by, "left")
    if buckets:
        out = out.join(valid.groupBy(*by).agg(histogram_map(buckets, "ingest_latency_ms").alias("histogram")), by, "left")
    return out


def counter_delta(snapshots: DataFrame, columns: list[str], by: list[str], time: str) -> DataFrame:
    """Increase of each counter since the snapshot before; the first counts from 0, decreases give 0."""
    w = W.partitionBy(*by).orderBy(time)
    delta = {c: F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)) for c in columns}
    return snapshots.select(*by, time, *[d.alias(f"{c}_delta") for c, d in delta.items()])
