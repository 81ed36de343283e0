"""Rule scores, the ensemble, and detection as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT_CATALOG, METHODS, Autoencoder, Catalog, Detection, Drift, Ewma, HalfSpace, Rule
from tidemark.functions.expr import clip01, fixed2
from tidemark.operators.detectors import (
    AdwinDrift,
    EwmaScore,
    FrozenModels,
    HalfSpaceSlots,
    HalfSpaceTrees,
    OnlineAutoencoder,
)
from tidemark.operators.enrich import metric_vector
from tidemark.operators.scan import ordered_scan
from tidemark.operators.split_scan import numbered, split_scan

DEVICE = ["tenant_id", "device_id"]
SENSOR = ["tenant_id", "device_id", "sensor_type"]
ORDER = ["timestamp", "event_id"]

# Rule scores, and the score from which a warning is emitted.
CRITICAL, WARN = 1.0, 0.6


def _one_rule(rule: Rule, v: Column) -> Column:
    score = F.lit(0.0)
    for test, critical, warn in (
        (v.__ge__, rule.critical_above, rule.warn_above),
        (v.__le__, rule.critical_below, rule.warn_below),
    ):
        side = F.lit(0.0)
        if warn is not None:
            side = F.when(test(warn), WARN).otherwise(side)
        if critical is not None:
            side = F.when(test(critical), CRITICAL).otherwise(side)
        score = F.greatest(score, side)
    return score


def rule_scores(catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """map<field, score> with an entry for every metric of the event."""

    def score(field, value):
        out = None
        for name, rule in catalog.rules.items():
            branch = _one_rule(rule, value)
            out = F.when(field == name, branch) if out is None else out.when(field == name, branch)
        return F.lit(0.0) if out is None else out.otherwise(0.0)

    return F.transform_values("metrics", score)


def with_rules(df: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Adds rule_scores and rule_based, the largest of them (0 without metrics)."""
    df = df.withColumn("rule_scores", rule_scores(catalog))
    return df.withColumn("rule_based", F.coalesce(F.array_max(F.map_values("rule_scores")), F.lit(0.0)))


def ewma_score(df: DataFrame, cfg: Ewma = Ewma(), **scan) -> DataFrame:
    """Adds statistical. A device's metrics advance together; a device with most of the rows is cut into blocks of time."""
    return split_scan(df, DEVICE, ORDER, EwmaScore(cfg), **scan)


def _trees(cfg: HalfSpace, catalog: Catalog) -> HalfSpaceTrees:
    limits = {n: [(f.min, f.max) for f in t.fields.values()] for n, t in catalog.sensor_types.items()}
    return HalfSpaceTrees(cfg, limits)


def hst_score(df: DataFrame, cfg: HalfSpace = HalfSpace(), catalog: Catalog = DEFAULT_CATALOG, **blocks) -> DataFrame:
    """Adds isolation_forest.

    A window is scored by the one before it alone. Rows get their position
    within the device, each row goes to its own window and to the next as
    reference, and every group is at most two windows of rows.
    """
    df = df.withColumn("vector", metric_vector(catalog))
    return _slot_scores(numbered(df, SENSOR, ORDER, "_row", **blocks), cfg, catalog).drop("vector")


def _slot_scores(placed: DataFrame, cfg: HalfSpace, catalog: Catalog) -> DataFrame:
    """Adds isolation_forest to rows with their vector and position (_row), which is dropped."""
    slot = F.floor(F.col("_row") / cfg.window)
    spread = F.array(*[F.struct((slot + 1 - r).alias("slot"), F.lit(r).alias("role")) for r in (0, 1)])
    slotted = placed.select(*placed.columns, F.inline(spread))
    trees = HalfSpaceSlots(cfg, _trees(cfg, catalog).limits)
    scored = ordered_scan(slotted, [*SENSOR, "slot"], ["role", "_row"], [trees])
    return scored.filter("role = 1").drop("_row", "slot", "role")


def autoencoder_score(
    df: DataFrame,
    cfg: Autoencoder = Autoencoder(),
    catalog: Catalog = DEFAULT_CATALOG,
    models: FrozenModels | None = None,
) -> DataFrame:
    """Adds autoencoder, ae_recon_mse and ae_train_mse; frozen models take the sensor types they cover."""
    if not cfg.enabled:
        return df.withColumns({n: F.lit(0.0 if n == "autoencoder" else None).cast("double") for n, _ in _AE.fields})
    df = df.withColumn("vector", metric_vector(catalog))
    return ordered_scan(df, SENSOR, ORDER, [OnlineAutoencoder(cfg, models)]).drop("vector")


_AE = OnlineAutoencoder


def score_frozen(
    df: DataFrame, models: FrozenModels, cfg: Autoencoder = Autoencoder(), catalog: Catalog = DEFAULT_CATALOG
) -> DataFrame:
    return autoencoder_score(df, cfg, catalog, models)


def primary_metric() -> Column:
    """The first metric in the order the event listed them."""
    return F.get(F.map_values("metrics"), F.lit(0))


def adwin_drift(df: DataFrame, cfg: Drift = Drift()) -> DataFrame:
    """Adds drift_detected."""
    if not cfg.enabled:
        return df.withColumn("drift_detected", F.lit(False))
    df = df.withColumn("primary", primary_metric())
    return ordered_scan(df, DEVICE, ORDER, [AdwinDrift(cfg)]).drop("primary")


def severity(score: Column, drift: Column) -> Column:
    return (
        F.when((drift & (score >= 0.5)) | (score >= 0.9), "critical")
        .when(score >= 0.75, "high")
        .when(score >= 0.65, "medium")
        .otherwise("low")
    )


def ensemble(df: DataFrame, cfg: Detection = Detection(), extra: tuple[str, ...] = ()) -> DataFrame:
    """Combines the method columns into anomaly rows; events without a finding give no row.

    Reads the four method columns, rule_scores, drift_detected and the
    autoencoder's errors; a method whose column is absent counts as 0.
    """
    have = set(df.columns)
    methods = [m for m in METHODS if m in have] + [m for m in cfg.weights if m in have and m not in METHODS]
    value = {m: F.coalesce(F.col(m), F.lit(0.0)) for m in methods}
    score = F.lit(0.0)
    for m in cfg.weights:
        if m in value:
            score = score + F.lit(cfg.weights[m]) * value[m]
    drift = F.coalesce(F.col("drift_detected"), F.lit(False)) if "drift_detected" in have else F.lit(False)
    df = df.withColumns({"score": clip01(score), "drift_detected": drift})
    rule = value.get("rule_based", F.lit(0.0))
    df = df.withColumn("is_anomaly", (F.col("score") >= cfg.alert_threshold) | (rule >= CRITICAL))
    df = df.filter(F.col("is_anomaly") | F.col("drift_detected") | (rule >= WARN))

    named = [F.create_map(F.lit(m), value[m]) for m in methods]
    for detail in ("ae_recon_mse", "ae_train_mse"):
        if detail in have:
            named.append(F.create_map(F.lit(detail), F.col(detail)))
    detail = F.map_concat(*named)
    if "rule_scores" in have:
        prefixed = F.transform_keys("rule_scores", lambda k, _: F.concat(F.lit("rule_"), k))
        detail = F.map_concat(detail, prefixed)
    # the first of the best, in METHODS order
    ranked = [m for m in methods if m in cfg.weights]
    best = F.greatest(*[value[m] for m in ranked]) if len(ranked) > 1 else value[ranked[0]]
    top = F.coalesce(*[F.when(value[m] == best, F.lit(m)) for m in ranked])
    found = F.concat(F.lit("ensemble="), fixed2(F.col("score")), F.lit(", top="), top, F.lit("="), fixed2(best))
    return df.select(
        *[c for c in ("event_id", *SENSOR, "timestamp") if c in have],
        "score",
        "is_anomaly",
        severity(F.greatest(F.col("score"), rule), F.col("drift_detected")).alias("severity"),
        F.map_filter(detail, lambda _, v: v.isNotNull()).alias("methods"),
        "drift_detected",
        F.concat_ws(
            "; ",
            F.when(F.col("is_anomaly"), found),
            F.when(F.col("drift_detected"), F.lit("concept drift detected")),
        ).alias("message"),
        *extra,
    )


# name -> function adding a score column of that name; counted in by a weight of the same name
Detector = Callable[[DataFrame], DataFrame]


def score_all(
    df: DataFrame,
    cfg: Detection = Detection(),
    catalog: Catalog = DEFAULT_CATALOG,
    models: FrozenModels | None = None,
    extra_detectors: dict[str, Detector] | None = None,
) -> DataFrame:
    """All method columns for every event, with one shuffle by device.

    Averages and trees alone can be cut, and a device with most of the rows is
    then spread over blocks of time and windows; `df` is read more than once.
    Otherwise both passes read the same partitions; the second only sorts them again,
    by sensor type within the device. The autoencoder and the drift detector
    need every event of a device in order, so one device is one stream here;
    it is read in batches and never held as a whole.
    """
    keep = [c for c in ("event_id", *SENSOR, "timestamp", "metrics", "is_anomaly") if c in df.columns]
    df = with_rules(df.select(*keep), catalog)
    if cfg.drift.enabled or cfg.autoencoder.enabled:
        df = df.withColumns({"vector": metric_vector(catalog), "primary": primary_metric()})
        by_device = [EwmaScore(cfg.ewma)] + ([AdwinDrift(cfg.drift)] if cfg.drift.enabled else [])
        by_sensor = [_trees(cfg.trees, catalog)] + (
            [OnlineAutoencoder(cfg.autoencoder, models)] if cfg.autoencoder.enabled else []
        )
        df = ordered_scan(df, DEVICE, ORDER, by_device)
        df = ordered_scan(df, SENSOR, ORDER, by_sensor, co_partitioned=True).drop("vector", "primary")
    else:
        placed = numbered(df.withColumn("vector", metric_vector(catalog)), SENSOR, ORDER, "_row")
        df = _slot_scores(ewma_score(placed, cfg.ewma), cfg.trees, catalog).drop("vector")
    for detector in (extra_detectors or {}).values():
        df = detector(df)
    return df


def detect(
    df: DataFrame,
    cfg: Detection = Detection(),
    catalog: Catalog = DEFAULT_CATALOG,
    models: FrozenModels | None = None,
    extra_detectors: dict[str, Detector] | None = None,
) -> DataFrame:
    """Anomaly rows of a table of enriched events."""
    scored = score_all(df.drop("is_anomaly"), cfg, catalog, models, extra_detectors)
    found = ensemble(scored, cfg)
    return found if cfg.enabled else found.limit(0)
