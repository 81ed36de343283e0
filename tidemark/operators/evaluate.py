"""Quality of the detection against labelled events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import METHODS, Evaluation

ORDER = ("timestamp", "event_id")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def quality(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and accuracy to counts tp, fp, tn, fn; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, r = F.col("precision"), F.col("recall")
    return (
        df.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * p * r, p + r))
        .withColumn("accuracy", _ratio(tp + tn, tp + fp + tn + fn))
    )


def confusion(predicted: Column, suffix: str = "") -> list[Column]:
    actual, predicted = F.col("is_anomaly"), F.coalesce(predicted, F.lit(False))
    return [
        F.count_if(actual & predicted).alias(f"tp{suffix}"),
        F.count_if(~actual & predicted).alias(f"fp{suffix}"),
        F.count_if(~actual & ~predicted).alias(f"tn{suffix}"),
        F.count_if(actual & ~predicted).alias(f"fn{suffix}"),
    ]


def eval_rows(events: DataFrame, anomalies: DataFrame, warmup: int = 50, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Labelled events after the warm-up with what was emitted for them.

    The first min(warmup, labelled / 2) labelled events are left out. They are
    a top-k by `order`, not a ranking of the whole table. Columns: event_id,
    is_anomaly (the label), emitted, flagged, score, methods.
    """
    labelled = events.filter(F.col("is_anomaly").isNotNull()).select("event_id", "is_anomaly", *order)
    half = labelled.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    first = labelled.orderBy(*order).limit(warmup).select("event_id", *order)
    ranks = first.agg(F.sort_array(F.collect_list(F.struct(*order, F.col("event_id").alias("id")))).alias("a"))
    skipped = (
        ranks.select(F.posexplode("a").alias("pos", "e"))
        .join(F.broadcast(half))  # one row; at most `warmup` rows on the other side
        .filter(F.col("pos") < F.col("half"))
        .select(F.col("e.id").alias("event_id"))
    )
    found = anomalies.select(
        "event_id", F.lit(True).alias("emitted"), F.col("is_anomaly").alias("flagged"), "score", "methods"
    )
    return labelled.join(skipped, "event_id", "left_anti").join(found, "event_id", "left").drop(*order[:-1])


def predicted_at(threshold: Column | float) -> Column:
    """An emitted row counts as positive when flagged, or when its score reaches the threshold."""
    return F.col("flagged") | (F.col("score") >= threshold)


def _method_counts(methods: tuple[str, ...], threshold: float) -> list[Column]:
    counts = []
    for m in methods:
        value = F.coalesce(F.try_element_at("methods", F.lit(m)), F.lit(0.0))
        counts += confusion(F.col("emitted") & (value >= threshold), f"_{m}")
    return counts


def _sweep_counts(thresholds: tuple[float, ...], use_raw_scores: bool) -> list[Column]:
    counts = []
    for i, t in enumerate(thresholds):
        t = round(t, 2)
        hit = (F.col("score") >= t) if use_raw_scores else predicted_at(t)
        counts += confusion(hit, f"_t{i}")
    return counts


def _method_rows(methods: tuple[str, ...]) -> Column:
    return _unstack("method", [(m, F.lit(m)) for m in methods])


def _sweep_rows(thresholds: tuple[float, ...]) -> Column:
    return _unstack("threshold", [(f"t{i}", F.lit(float(round(t, 2)))) for i, t in enumerate(thresholds)])


def _unstack(name: str, entries: list[tuple[str, Column]]) -> Column:
    """The counts of one wide row as array<struct(name, tp, fp, tn, fn)>."""
    return F.array(
        *[
            F.struct(value.alias(name), *[F.col(f"{c}_{suffix}").alias(c) for c in ("tp", "fp", "tn", "fn")])
            for suffix, value in entries
        ]
    )


def evaluate(rows: DataFrame, threshold: float = 0.65) -> DataFrame:
    """One row of counts and quality from `eval_rows`."""
    return quality(rows.agg(*confusion(predicted_at(threshold))))


def evaluate_methods(rows: DataFrame, threshold: float = 0.65, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """One row per method; all of them come out of a single aggregation."""
    return quality(rows.agg(*_method_counts(methods, threshold)).select(F.inline(_method_rows(methods))))


def threshold_sweep(
    rows: DataFrame, thresholds: tuple[float, ...] = Evaluation().threshold_sweep, *, use_raw_scores: bool = False
) -> DataFrame:
    """One row per threshold, from a single aggregation.

    Rows that were not emitted are never positive and flagged rows always are,
    so the sweep moves little. With use_raw_scores the score alone decides
    (`rows` must then carry the score of every event).
    """
    return quality(rows.agg(*_sweep_counts(thresholds, use_raw_scores)).select(F.inline(_sweep_rows(thresholds))))


def report(
    dataset: str,
    events: DataFrame,
    anomalies: DataFrame,
    cfg: Evaluation = Evaluation(),
    alert_threshold: float = 0.65,
    methods: tuple[str, ...] = METHODS,
) -> DataFrame:
    """One nested row: counts, quality, per-method quality and the threshold sweep.

    All counts come from one pass over the evaluated rows. `events` is read
    for the warm-up as well, so give it as a stored table when it is costly.
    """
    threshold = cfg.threshold if cfg.threshold is not None else alert_threshold
    rows = eval_rows(events, anomalies, cfg.warmup_events)
    counts = rows.agg(
        *confusion(predicted_at(threshold)),
        *_method_counts(methods, threshold),
        *_sweep_counts(cfg.threshold_sweep, False),
    )
    totals = events.agg(
        F.count(F.lit(1)).alias("total_events"), F.count("is_anomaly").alias("labeled_events")
    ).withColumn("warmup_events", F.least(F.lit(cfg.warmup_events), F.floor(F.col("labeled_events") / 2)))
    one = totals.join(F.broadcast(counts)).select(  # one row each
        "total_events", "labeled_events", "warmup_events", "tp", "fp", "tn", "fn",
        _method_rows(methods).alias("_m"), _sweep_rows(cfg.threshold_sweep).alias("_s"),
    )
    scored = ("precision", "recall", "f1", "tp", "fp", "tn", "fn")
    return quality(one).select(
        F.lit(dataset).alias("dataset"), "total_events", "labeled_events", "warmup_events",
        F.lit(threshold).alias("threshold"), F.struct("tp", "fp", "tn", "fn").alias("confusion"),
        "precision", "recall", "f1", "accuracy",
        F.map_from_entries(
            F.transform("_m", lambda e: F.struct(e["method"].alias("key"), _quality_struct(e, scored).alias("value")))
        ).alias("per_method"),
        F.transform("_s", lambda e: _quality_struct(e, scored, e["threshold"].alias("threshold"))).alias(
            "threshold_sweep"
        ),
    )


def _quality_struct(e: Column, names: tuple[str, ...], *lead: Column) -> Column:
    tp, fp, fn = (e[c].cast("double") for c in ("tp", "fp", "fn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    value = {"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r)}
    return F.struct(*lead, *[value.get(n, e[n]).alias(n) for n in names])


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("dataset", F.to_json(F.struct(*reports.columns)).alias("report"))


def compare_runs(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of several configurations or datasets under each other, with a run column."""
    out = None
    for run, df in reports.items():
        df = df.select(F.lit(run).alias("run"), "*")
        out = df if out is None else out.unionByName(df)
    return out


def ml_quality(reports: DataFrame) -> DataFrame:
    """Long form (dataset, method, precision, recall, f1); the whole ensemble counts as a method."""
    keep = ("precision", "recall", "f1")
    whole = F.struct(F.lit("ensemble").alias("method"), *keep)
    parts = F.transform(
        F.map_entries("per_method"),
        lambda e: F.struct(e["key"].alias("method"), *[e["value"][c].alias(c) for c in keep]),
    )
    return reports.select("dataset", F.inline(F.concat(F.array(whole), parts)))
