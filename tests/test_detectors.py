import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Autoencoder, Detection, Drift, Ewma
from tidemark.operators import scoring as sc
from tidemark.operators.alerts import alert_candidates, alert_payload, alerts, cooldown
from tidemark.config import Alerting
from tidemark.operators.detectors import Adwin, FrozenModels
from tests.events import by_id, column, events


def series(values, field="temperature", step=1.0, **more):
    return [{"seconds": i * step, "metrics": {field: float(v)}, **more} for i, v in enumerate(values)]


def test_spike_scores_high(spark):
    scored = sc.ewma_score(events(spark, series([65, 66, 64, 65, 66, 65, 64, 150])), Ewma(z_score_threshold=3.0, min_samples=5))
    scores = column(scored, "statistical")
    assert scores[:4] == [0.0] * 4
    assert scores[-1] > 0.5 and scores[-1] > 3 * max(scores[4:-1]) / 2


def autoencoder_loop(vectors, cfg):
    rng = np.random.default_rng(cfg.seed)
    d = len(vectors[0])
    w1, w2 = rng.normal(0, 0.1, (d, cfg.hidden_dim)), rng.normal(0, 0.1, (cfg.hidden_dim, d))
    mean, std, ema, out = None, np.ones(d), 0.0, []
    for n, raw in enumerate(np.asarray(vectors), 1):
        mean = raw if mean is None else mean
        mean = 0.95 * mean + 0.05 * raw
        std = 0.95 * std + 0.05 * (np.abs(raw - mean) + 1e-3)
        x = np.clip((raw - mean) / std, -10, 10)
        h = np.maximum(x @ w1, 0)
        err = h @ w2 - x
        mse = (err**2).mean()
        g1 = np.outer(x, (2 * err @ w2.T) * (h > 0))
        w2 = w2 - cfg.learning_rate * np.outer(h, 2 * err)
        w1 = w1 - cfg.learning_rate * g1
        ema = mse if n == 1 else 0.05 * mse + 0.95 * ema
        after = ((np.maximum(x @ w1, 0) @ w2 - x) ** 2).mean()
        score = np.clip((after / max(ema, 1e-9) - 1) / cfg.error_threshold, 0, 1) if n >= cfg.min_samples else 0.0
        out.append((score, after, mse if n >= cfg.min_samples else None))
    return out


def test_autoencoder_equals_the_loop(spark):
    cfg = Autoencoder(min_samples=5)
    rng = np.random.default_rng(2)
    rows = []
    for device, n in (("a", 40), ("b", 3), ("c", 25)):
        for i in range(n):
            v = rng.normal([65, 4.5, 3.2], [2, 0.15, 0.4]).tolist()
            rows.append({"seconds": i, "device_id": device, "metrics": dict(zip(("temperature", "pressure", "vibration"), v))})
    got = by_id(sc.autoencoder_score(events(spark, rows), cfg), "autoencoder", "ae_recon_mse", "ae_train_mse")
    for device in "abc":
        mine = [(f"e{i:05d}", list(r["metrics"].values())) for i, r in enumerate(rows) if r["device_id"] == device]
        for (e, _), want in zip(mine, autoencoder_loop([v for _, v in mine], cfg)):
            for g, w in zip(got[e], want):
                assert (g is None) == (w is None)
                assert w is None or g == pytest.approx(w, abs=1e-9)


def test_autoencoder_error_grows_with_distance(spark):
    values = [65.0 + 0.01 * i for i in range(50)]
    error = lambda last: column(
        sc.autoencoder_score(events(spark, series([*values, last]))), "ae_recon_mse"
    )[-1]
    assert error(115.0) > error(65.5)


def test_adwin_finds_a_level_shift():
    window = Adwin(0.01)
    flags = [window.add(v) for v in [1.0] * 100 + [10.0] * 100]
    assert not any(flags[:100]) and any(flags[100:])
    assert window.total / window.width > 5
    steady = Adwin(0.002)
    assert not any(steady.add(1.0) for _ in range(2000))
    assert sum(len(r) for r in steady.rows) < 100


def test_adwin_keeps_exact_totals():
    rng = np.random.default_rng(0)
    window, values = Adwin(1e-9), rng.normal(5, 1, 500)
    for v in values:
        window.add(v)
    assert window.width == 500
    assert window.total == pytest.approx(values.sum())
    assert window.m2 / 500 == pytest.approx(values.var(), rel=1e-6)
    assert sum(t for r in window.rows for t, _ in r) == pytest.approx(values.sum())


def plain_adwin(values, delta):
    """The detector over the plain list of its window: bucket borders by one value after the other, all figures from the values themselves."""
    values = np.asarray(values, dtype=float)
    rows, start, flags = [[]], 0, []
    for i in range(len(values)):
        rows[0].append(1)
        for k in range(len(rows)):
            if len(rows[k]) <= Adwin.MAX_BUCKETS:
                break
            if k + 1 == len(rows):
                rows.append([])
            rows[k + 1].append(rows[k].pop(0) + rows[k].pop(0))
        changed = False
        while (i + 1) % Adwin.CLOCK == 0 and i + 1 - start > Adwin.GRACE:
            window = values[start : i + 1]
            n, found, n0 = len(window), False, 0
            confidence = np.log(2 * np.log(n) / delta)
            for size in [size for row in rows[::-1] for size in row]:
                n0 += size
                n1 = n - n0
                if n0 >= Adwin.MIN_SIDE and n1 >= Adwin.MIN_SIDE:
                    m = 1 / (1 / (n0 - Adwin.MIN_SIDE + 1) + 1 / (n1 - Adwin.MIN_SIDE + 1))
                    bound = np.sqrt(2 / m * window.var() * confidence) + 2 / (3 * m) * confidence
                    found |= bool(abs(window[:n0].mean() - window[n0:].mean()) > bound)
            if not found:
                break
            changed = True
            start += rows[-1].pop(0)
            if not rows[-1] and len(rows) > 1:
                rows.pop()
        flags.append(changed)
    return flags


def test_adwin_equals_the_plain_list(spark):
    rng = np.random.default_rng(7)
    shapes = [
        np.r_[rng.normal(0, 1, 400), rng.normal(3, 1, 300), rng.normal(3, 4, 300), rng.normal(-2, 0.1, 200)],
        np.r_[rng.random(333), 5 + rng.random(77), rng.random(500)],
        np.cumsum(rng.normal(0, 0.2, 1500)),
        np.full(300, 2.5),
    ]
    for delta in (0.002, 0.3):
        for values in shapes:
            want = plain_adwin(values, delta)
            one = Adwin(delta)
            assert [one.add(v) for v in values] == want
            parts, many = [], Adwin(delta)
            for part in np.split(values, [1, 2, 40, 41, 200]):
                many = Adwin(delta, many.state())
                parts += many.extend(part).tolist()
            assert parts == want
    assert sum(plain_adwin(shapes[0], 0.002)) >= 2
    rows = [{"seconds": i, "device_id": d, "metrics": {"temperature": float(v)}} for d, values in zip("abc", shapes) for i, v in enumerate(values)]
    got = sc.adwin_drift(events(spark, rows), Drift(check_interval_seconds=0))
    for d, values in zip("abc", shapes):
        assert column(got.filter(F.col("device_id") == d), "drift_detected") == plain_adwin(values, 0.002)


def test_drift_flag_and_check_interval(spark):
    rows = series([1.0] * 100 + [10.0] * 100)
    every = column(sc.adwin_drift(events(spark, rows), Drift(adwin_delta=0.01, check_interval_seconds=0)), "drift_detected")
    assert not any(every[:100]) and any(every[100:])
    assert len([f for f in every if f]) < 5
    # read once a minute: the verdict stays for 60 events of a second each, or is missed
    held = column(sc.adwin_drift(events(spark, rows), Drift(adwin_delta=0.01, check_interval_seconds=32 * 2)), "drift_detected")
    for i in range(1, 200):
        assert i % 64 == 0 or held[i] == held[i - 1]
    assert not any(column(sc.adwin_drift(events(spark, rows), Drift(enabled=False)), "drift_detected"))


def test_drift_looks_at_the_first_metric(spark):
    rows = [{"seconds": i, "metrics": {"zeta": 1.0, "alpha": 1.0 if i < 100 else 10.0}} for i in range(200)]
    assert not any(column(sc.adwin_drift(events(spark, rows), Drift(adwin_delta=0.01, check_interval_seconds=0)), "drift_detected"))


def test_frozen_model(spark):
    identity = [np.hstack([np.eye(3), -np.eye(3)]), np.vstack([np.eye(3), -np.eye(3)])]
    zero = [np.zeros((3, 1)), np.zeros((1, 3))]
    rng = np.random.default_rng(4)
    rows = []
    for i in range(30):
        for kind, fields in (("industrial", ("temperature", "pressure", "vibration")), ("vehicle", ("speed", "engine_rpm", "fuel_level")), ("network", ("bytes_in", "bytes_out", "packet_loss"))):
            rows.append({"seconds": i, "device_id": kind, "sensor_type": kind, "metrics": dict(zip(fields, rng.random(3).tolist()))})
    df = events(spark, rows)
    out = sc.score_frozen(df, FrozenModels({"industrial": identity, "vehicle": zero}), Autoencoder(min_samples=5))
    got = {k: [r for r in out.filter(F.col("sensor_type") == k).orderBy("timestamp").collect()] for k in ("industrial", "vehicle", "network")}
    assert all(r["ae_recon_mse"] == pytest.approx(0, abs=1e-12) for r in got["industrial"])
    assert got["vehicle"][5]["autoencoder"] == pytest.approx(min(1, got["vehicle"][5]["ae_recon_mse"] / 0.15))
    online = by_id(sc.autoencoder_score(df, Autoencoder(min_samples=5)), "autoencoder", "ae_recon_mse")
    for r in got["network"]:
        assert (r["autoencoder"], r["ae_recon_mse"]) == pytest.approx(online[r["event_id"]])


def test_rules(spark):
    rows = [
        {"seconds": 0, "metrics": {"temperature": 115.0, "pressure": 4.5, "vibration": 3.2}},
        {"seconds": 1, "metrics": {"temperature": 95.0, "pressure": 1.0}},
        {"seconds": 2, "metrics": {"temperature": 94.9, "pressure": 1.01, "speed": 1e9}},
        {"seconds": 3, "metrics": {"pressure": 0.5}},
    ]
    assert column(sc.with_rules(events(spark, rows)), "rule_based") == [1.0, 0.6, 0.0, 1.0]


def scored(spark, rows):
    columns = "event_id string, tenant_id string, device_id string, sensor_type string, timestamp timestamp, statistical double, isolation_forest double, autoencoder double, rule_based double, drift_detected boolean, rule_scores map<string,double>"
    from tests.events import at

    data = [
        (f"e{i}", "t", r.get("device", "d1"), "industrial", at(r.get("seconds", i)), *r["methods"], r.get("drift", False), r.get("rules", {}))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, columns)


def test_ensemble_rows(spark):
    df = scored(
        spark,
        [
            {"methods": (1.0, 1.0, 0.5, 0.0)},  # .25 + .3 + .15 = .7
            {"methods": (0.1, 0.5, 0.0, 0.0)},  # nothing
            {"methods": (0.0, 0.5, 0.0, 0.6), "rules": {"temperature": 0.6}},  # warning: a row, not an anomaly
            {"methods": (0.0, 0.5, 0.0, 1.0)},  # critical rule
            {"methods": (0.0, 0.0, 0.0, 0.0), "drift": True},  # drift only
            {"methods": (1.0, 0.8, 0.2, 0.0), "drift": True},
        ],
    )
    rows = {r["event_id"]: r for r in sc.ensemble(df).collect()}
    assert set(rows) == {"e0", "e2", "e3", "e4", "e5"}
    assert rows["e0"]["is_anomaly"] and rows["e0"]["severity"] == "medium"
    assert rows["e0"]["message"] == "ensemble=0.70, top=statistical=1.00"
    assert not rows["e2"]["is_anomaly"] and rows["e2"]["message"] == "" and rows["e2"]["severity"] == "low"
    assert rows["e2"]["methods"]["rule_temperature"] == 0.6
    assert rows["e3"]["is_anomaly"] and rows["e3"]["severity"] == "critical"
    assert rows["e3"]["message"] == "ensemble=0.30, top=rule_based=1.00"
    assert rows["e4"]["message"] == "concept drift detected" and rows["e4"]["severity"] == "low"
    assert rows["e5"]["severity"] == "critical"


def test_extra_detector_counts_by_its_weight(spark):
    df = events(spark, series([60.0] * 5))
    cfg = Detection(weights={"mine": 1.0})
    out = sc.detect(df, cfg, extra_detectors={"mine": lambda d: d.withColumn("mine", F.lit(0.9))})
    assert {r["score"] for r in out.collect()} == {0.9}
    assert sc.detect(df, Detection(enabled=False)).count() == 0


def test_detect_flags_a_critical_rule(spark):
    out = sc.detect(events(spark, [*series([65.0] * 5), {"seconds": 9, "metrics": {"temperature": 115.0, "pressure": 4.5, "vibration": 3.2}}]))
    assert [r["is_anomaly"] for r in out.collect()] == [True]


def test_alert_gate_cooldown_and_payload(spark):
    rows = [{"methods": (1.0, 1.0, 0.5, 0.0), "seconds": s} for s in (0, 100, 300, 599, 600)]
    found = sc.ensemble(scored(spark, [*rows, {"methods": (0.0, 0.5, 0.0, 0.6), "seconds": 900}]))
    assert alert_candidates(found).count() == 5
    assert alert_candidates(found, "low").count() == 6
    assert alert_candidates(found, "high").count() == 0
    sent = column(cooldown(alert_candidates(found), 300.0), "event_id")
    assert sent == ["e0", "e2", "e4"]
    assert alerts(found, Alerting(cooldown_seconds=300)).count() == 3
    import json

    body = json.loads(alert_payload(found).orderBy("timestamp").first()["payload"])["attachments"][0]
    assert body["color"] == "#daa038" and body["ts"] == 1704067200
    assert {f["title"]: f["value"] for f in body["fields"]} == {
        "Device": "d1", "Sensor Type": "industrial", "Score": "0.70", "Severity": "MEDIUM", "Top Signal": "statistical=1.00",
    }


def test_a_device_with_all_rows_is_spread_where_its_methods_can_be_cut(spark):
    """Averages and trees alone had been run over all rows of a device in one task."""
    from tidemark.config import HalfSpace
    from tidemark.operators.enrich import metric_vector
    from tidemark.operators.scan import ordered_scan

    cfg = Detection(trees=HalfSpace(n_trees=3, height=4, window=8), drift=Drift(enabled=False), autoencoder=Autoencoder(enabled=False))
    values = np.random.default_rng(4).normal(65, 20, 90)
    rows = series(values, step=9000.0) + [{"seconds": i * 9000.0, "device_id": None, "metrics": {"temperature": 50.0 + i}, "event_id": f"n{i}"} for i in range(20)]
    df = events(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = sc.score_all(df, cfg).cache()
        assert scored.filter("device_id = 'd1'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = by_id(scored, "statistical", "isolation_forest", "rule_based")
    whole = ordered_scan(sc.with_rules(df), sc.DEVICE, sc.ORDER, [sc.EwmaScore(cfg.ewma)]).withColumn("vector", metric_vector())
    want = by_id(ordered_scan(whole, sc.SENSOR, sc.ORDER, [sc._trees(cfg.trees, sc.DEFAULT_CATALOG)]), "statistical", "isolation_forest", "rule_based")
    assert set(got) == set(want) and len(got) == 110 and any(v[1] != 0.5 for v in got.values())
    assert all(got[e] == pytest.approx(want[e]) for e in want)


def test_short_and_long_series_are_averaged_as_pandas_does():
    """Most series are a few values; they had been averaged one by one."""
    import pandas as pd

    rng = np.random.default_rng(2)
    lengths = np.r_[rng.integers(1, 6, 300), 63, 64, 65, 66, 200]
    series_no = np.repeat(np.arange(len(lengths)), lengths)
    x = np.round(rng.normal(size=len(series_no)), 1)
    scan = sc.EwmaScore(Ewma(alpha=0.3))
    for values in (x, np.where(rng.random(len(x)) < 0.1, np.nan, x)):
        want = pd.Series(values).groupby(series_no, sort=False).ewm(alpha=0.3, adjust=False).mean().to_numpy()
        assert np.array_equal(scan._ewm(values, series_no), want, equal_nan=True)
