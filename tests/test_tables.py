"""Sinks, CSV source, metrics, evaluation and serving queries on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT_CATALOG, Evaluation, Settings
from tidemark.operators import evaluate as ev
from tidemark.operators import metrics as me
from tidemark.operators import scoring as sc
from tidemark.plans import dashboards, flow
from tidemark.plans import serve as se
from tidemark.sinks import tables
from tidemark.sources.inject import inject_anomalies
from tidemark.sources.labeled_csv import read_labeled_csv
from tests.events import by_id, events

GOOD = {"temperature": 65.0, "pressure": 4.5, "vibration": 3.2}


def test_events_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "events")
    df = events(spark, [{"seconds": i * 40000, "metrics": GOOD} for i in range(6)])
    tables.write_events(df, path)
    tables.write_events(df.unionByName(events(spark, [{"seconds": 1, "metrics": GOOD, "event_id": "new"}])), path)
    assert spark.read.parquet(path).count() == 7
    assert tables.read_table(spark, path, since="2024-01-02", until="2024-01-03").count() == 2
    plan = tables.read_table(spark, path, since="2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date" in plan
    tables.compact(spark, path, str(tmp_path / "packed"), 1, "2024-01-03 12:00:00")
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 4
    assert tables.apply_retention(spark, path, 1, "2024-01-03 12:00:00") == ["2024-01-01"]
    assert spark.read.parquet(path).count() == 3
    assert tables.count_only(df) == 6


def test_wide_csv(spark, tmp_path):
    lines = ["timestamp,value,note,is_anomaly"]
    lines += [f"2024-01-01T00:00:{i:02d}+00:00,{50 + i},x,{1 if i == 7 else 0}" for i in range(20)]
    lines += ["2024-01-01T00:01:00+00:00,3.5,x,"]
    path = tmp_path / "a.csv"
    path.write_text("\n".join(lines))
    rows = read_labeled_csv(spark, str(path)).orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(21))
    assert rows[7]["is_anomaly"] and rows[7]["anomaly_label"] == "dataset_label" and rows[20]["is_anomaly"] is None
    assert rows[0]["metrics"] == {"value": 50.0} and rows[0]["tags"] == {"source": "replay", "file": "a.csv"}
    (tmp_path / "b.csv").write_text("v,label\n5,1\n3,0\n4,0\n")
    rows = read_labeled_csv(spark, str(tmp_path / "b.csv")).orderBy("sequence").collect()
    assert [r["metrics"]["v"] for r in rows] == [5.0, 3.0, 4.0]
    assert [str(r["timestamp"]) for r in rows] == [f"2024-01-01 00:00:0{i}" for i in range(3)]
    assert all(r["is_anomaly"] is None for r in rows)


def test_injection(spark):
    df = events(spark, [{"seconds": i, "metrics": GOOD, "device_id": "ab"[i % 2]} for i in range(400)])
    out = inject_anomalies(df, rate=0.3)
    picked = out.filter("is_anomaly").orderBy("timestamp").collect()
    assert 80 < len(picked) < 160
    seen = {"a": 0, "b": 0}
    for r in picked:
        m = r["metrics"]
        if r["anomaly_label"] == "spike:temperature":
            assert m["temperature"] == 120.0
        elif r["anomaly_label"] == "flatline:pressure":
            assert m["pressure"] == DEFAULT_CATALOG.sensor_types["industrial"].fields["pressure"].baseline
        else:
            assert r["anomaly_label"] == "drift:vibration"
            seen[r["device_id"]] += 1
            assert m["vibration"] == pytest.approx(3.2 + 0.05 * seen[r["device_id"]])
    assert all(r["metrics"] == GOOD for r in out.filter("not is_anomaly").collect())
    assert by_id(inject_anomalies(df.repartition(5), rate=0.3), "anomaly_label") == by_id(out, "anomaly_label")


def test_latency_numbers(spark):
    df = spark.createDataFrame([(float(v), i, str(i)) for i, v in enumerate(range(1, 101))], "ms double, ingested_at int, event_id string")
    r = me.latency_stats(df, "ms", (50, 95, 99, 100)).first()
    assert (r["samples"], r["mean"], r["p50"], r["p95"], r["p99"], r["p100"]) == (100, 50.5, 51, 96, 100, 100)
    assert me.latency_stats(df, "ms", (50,), last=10).first()["p50"] == 96
    assert me.interpolated(df.withColumn("g", F.lit(1)), "ms", 0.95, ["g"], "q").first()["q"] == pytest.approx(95.05)
    assert {r[0]: r[1] for r in me.latency_histogram(df, (10, 50, 100), "ms").collect()} == {"<=10": 10, "<=50": 40, "<=100": 50, ">max": 0}
    up_to = {r["le"]: r["count"] for r in me.cumulative_histogram(df, "ms").collect()}
    assert up_to["0.01"] == 10 and up_to["0.1"] == 100 and up_to["+Inf"] == 100


def test_latency_of_all_samples(spark):
    # 12 000 samples of one group, the oldest the slowest; and odd values in small groups
    rows = [("a", float(12_000 - i), i, str(i)) for i in range(12_000)]
    odd = {"b": [-3.5, 0.0, -0.0, 1e300, -1e-300, 2.0, float("inf")], None: [7.0], "c": [5.0 + i * 1e-9 for i in range(40)]}
    rows += [(g, v, i, str(i)) for g, vs in odd.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, ms double, ingested_at int, event_id string")
    got = {r["g"]: r for r in me.latency_stats(df, "ms", (0, 50, 95, 99, 100), ["g"]).collect()}
    a = got["a"]
    assert (a["samples"], a["mean"], a["p50"], a["p95"], a["p99"]) == (12_000, 6000.5, 6001, 11401, 11881)
    for g, vs in odd.items():
        want = [sorted(vs)[min(int(len(vs) * p / 100), len(vs) - 1)] for p in (0, 50, 95, 99, 100)]
        assert [got[g][f"p{p}"] for p in (0, 50, 95, 99, 100)] == want, g
    assert me.latency_stats(df, "ms", (50,), ["g"], last=100).filter("g = 'a'").first()["samples"] == 100


def test_throughput(spark):
    rate = lambda times: me.throughput(events(spark, [{"seconds": t, "metrics": GOOD} for t in times]), 5.0).first()[0]
    assert rate([0, 10, 12, 14]) == pytest.approx(3 / 4)
    assert rate([0, 10]) == pytest.approx(0.2)
    assert rate([10, 10, 10]) == 3.0


def labelled(spark):
    rng = random.Random(6)
    rows, found = [], []
    for i in range(100):
        rows.append({"seconds": i, "metrics": GOOD, "is_anomaly": None if i % 10 == 3 else rng.random() < 0.3})
        if rng.random() < 0.5:
            score, stat = round(rng.random(), 3), round(rng.random(), 3)
            found.append((f"e{i:05d}", score >= 0.65 or rng.random() < 0.1, score, {"statistical": stat}))
    anomalies = spark.createDataFrame(found, "event_id string, is_anomaly boolean, score double, methods map<string,double>")
    return rows, {f[0]: f for f in found}, events(spark, rows), anomalies


def count(pairs):
    tp, fp = sum(a and p for a, p in pairs), sum(p and not a for a, p in pairs)
    fn, tn = sum(a and not p for a, p in pairs), sum(not a and not p for a, p in pairs)
    return tp, fp, tn, fn


def test_evaluation_equals_the_loop(spark):
    rows, found, df, anomalies = labelled(spark)
    kept = [(f"e{i:05d}", r["is_anomaly"]) for i, r in enumerate(rows) if r["is_anomaly"] is not None][20:]
    predicted = lambda e, t: e in found and (found[e][1] or found[e][2] >= t)
    eval_rows = ev.eval_rows(df, anomalies, 20)
    got = ev.evaluate(eval_rows, 0.65).first()
    assert tuple(got[c] for c in ("tp", "fp", "tn", "fn")) == count([(a, predicted(e, 0.65)) for e, a in kept])
    for r in ev.threshold_sweep(eval_rows).collect():
        assert tuple(r[c] for c in ("tp", "fp", "tn", "fn")) == count([(a, predicted(e, r["threshold"])) for e, a in kept])
    # by the score alone, which every row carries (0 where nothing was emitted)
    for r in ev.threshold_sweep(eval_rows, (0.2, 0.5, 0.8), use_raw_scores=True).collect():
        reached = lambda e: (found[e][2] if e in found else 0.0) >= r["threshold"]  # noqa: B023, E731
        assert tuple(r[c] for c in ("tp", "fp", "tn", "fn")) == count([(a, reached(e)) for e, a in kept])
    methods = {r["method"]: r for r in ev.evaluate_methods(eval_rows, 0.5).collect()}
    want = count([(a, e in found and found[e][3]["statistical"] >= 0.5) for e, a in kept])
    assert tuple(methods["statistical"][c] for c in ("tp", "fp", "tn", "fn")) == want
    assert methods["autoencoder"]["precision"] == 0.0
    report = json.loads(ev.report_json(ev.report("x", df, anomalies, Evaluation(warmup_events=20))).first()["report"])
    assert report["labeled_events"] == 90 and report["warmup_events"] == 20 and len(report["threshold_sweep"]) == 9
    assert report["confusion"]["tp"] == got["tp"] and report["f1"] == pytest.approx(got["f1"])
    # never more than half of the labelled events are warm-up
    assert ev.eval_rows(df, anomalies, 1000).count() == 45


def test_quality_numbers(spark):
    row = ev.quality(spark.createDataFrame([(8, 2, 70, 5)], "tp int, fp int, tn int, fn int")).first()
    assert (row["precision"], row["recall"], row["accuracy"]) == pytest.approx((0.8, 8 / 13, 78 / 85))
    zero = ev.quality(spark.createDataFrame([(0, 0, 0, 0)], "tp int, fp int, tn int, fn int")).first()
    assert (zero["precision"], zero["recall"], zero["f1"], zero["accuracy"]) == (0, 0, 0, 0)


def test_whole_flow(spark):
    rng = random.Random(8)
    rows = [{"seconds": i, "metrics": {"temperature": 65 + rng.random(), "pressure": 4.5, "vibration": 3.0}} for i in range(60)]
    rows += [{"seconds": 60, "metrics": {"temperature": 119.0, "pressure": 4.5, "vibration": 3.0}}, {"seconds": 61, "metrics": {"x": 1.0}}]
    out = flow.process(events(spark, rows), Settings())
    assert {r["status"]: r["count"] for r in out.classified.groupBy("status").count().collect()} == {"valid": 61, "invalid": 1}
    assert out.window_stats.count() == 6 * 3
    last = out.anomalies.orderBy(F.desc("timestamp")).first()
    assert last["severity"] == "critical" and out.alerts.count() >= 1
    counters = me.event_counters(out.classified, out.anomalies).first()
    assert counters["events_ingested"] == 62 and counters["anomalies_detected"] == out.anomalies.count()
    line = se.sparkline(out.events.withColumn("v", F.col("sequence")), ["v"], 24).first()["v"]
    assert line == list(range(37, 61))
    health = se.device_health(se.list_devices(out.events), F.lit("2024-01-01 00:03:00").cast("timestamp")).first()
    assert health["health"] == "stale" and health["event_count"] == 61 and health["last_metrics"]["temperature"] == 119.0


def test_detection_reads_the_table_once_per_shuffle(spark, tmp_path):
    path = str(tmp_path / "t")
    events(spark, [{"seconds": i, "metrics": GOOD} for i in range(50)]).write.parquet(path)
    plan = sc.detect(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "tags" not in plan.split("ReadSchema")[1]


def test_tenant_rate_counts_steps_once(spark):
    rng = random.Random(2)
    df = events(spark, [{"seconds": rng.random() * 4000, "metrics": GOOD, "tenant_id": rng.choice("ab")} for _ in range(300)])
    for seconds, step in ((600, "2 minutes"), (600, "10 minutes"), (60, "7 seconds"), (3600, "1 hour"), (90, None)):
        frame = F.window("timestamp", f"{seconds} seconds", step) if step else F.window("timestamp", f"{seconds} seconds")
        want = df.groupBy("tenant_id", frame.alias("w")).count().select("tenant_id", F.col("w.end").alias("at"), (F.col("count") / float(seconds)).alias("rate"))
        got = dashboards.tenant_rate(df, seconds, step)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
