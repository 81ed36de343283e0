"""Streams over several micro-batches give what a batch job gives."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import Alerting, Detection, Drift, Ewma, HalfSpace, Settings, Tenancy
from tidemark.operators import scoring as sc
from tidemark.operators.alerts import alert_candidates, cooldown
from tidemark.operators.dedup import dedup
from tidemark.operators.windows import arrival_snapshots, arrival_windows, completed_arrival_windows, running_snapshots, tumbling
from tidemark.plans import flow
from tidemark.sources.replay import replay_stream
from tidemark.streaming import jobs
from tidemark.streaming.windows import window_stream
from tests.events import by_id, events

FIELDS = ("temperature", "pressure", "vibration")


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Events in time order, one file per stretch of time."""
    rng = random.Random(11)
    rows = []
    for i in range(90):
        metrics = dict(zip(FIELDS, (60 + rng.random() * 60, rng.random() * 9, rng.random() * 30)))
        rows.append({"seconds": i * 2.0, "device_id": rng.choice("abc"), "metrics": metrics})
        if i % 9 == 0:  # delivered again
            rows.append({**rows[-1], "ingested": i * 2.0 + rng.choice([1, 4])})
    rows.sort(key=lambda r: r.get("ingested", r["seconds"]))
    df = events(spark, rows).cache()
    path = str(tmp_path_factory.mktemp("history"))
    for part in range(3):
        low, high = part * 60, (part + 1) * 60
        at = F.unix_seconds("ingested_at") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
        df.filter((at >= low) & (at < (high if part < 2 else 10**6))).coalesce(1).write.mode("append").parquet(path)
    return df, path


def run(spark, df, tmp_path):
    schema = df.schema
    jobs.start_parquet(df, f"{tmp_path}/data", f"{tmp_path}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{tmp_path}/data")


def test_dedup(spark, history, tmp_path):
    df, path = history
    out = run(spark, jobs.dedup_stream(replay_stream(spark, path), 5.0), tmp_path)
    assert by_id(out, "device_id") == by_id(dedup(df, 5.0), "device_id")


def test_ewma(spark, history, tmp_path):
    df, path = history
    out = run(spark, jobs.ewma_stream(replay_stream(spark, path), Ewma(min_samples=5), None), tmp_path)
    want = by_id(sc.ewma_score(df, Ewma(min_samples=5)), "statistical")
    got = by_id(out, "statistical")
    assert set(got) == set(want)
    assert all(got[e] == pytest.approx(want[e]) for e in want)


def test_detection(spark, history, tmp_path):
    df, path = history
    cfg = Detection(trees=HalfSpace(n_trees=3, height=4, window=8), drift=Drift(check_interval_seconds=0))
    out = run(spark, jobs.detect_stream(replay_stream(spark, path), cfg, ttl_seconds=None), tmp_path)
    got, want = by_id(out, "score", "severity"), by_id(sc.detect(df, cfg), "score", "severity")
    assert len(want) > 5 and set(got) == set(want)
    assert all(got[e][0] == pytest.approx(want[e][0]) and got[e][1] == want[e][1] for e in want)


def test_cooldown_and_arrival_windows(spark, history, tmp_path):
    df, path = history
    found = sc.detect(df)
    found.orderBy("timestamp").coalesce(1).write.parquet(f"{tmp_path}/found")
    cfg = Alerting(cooldown_seconds=30)
    out = run(spark, jobs.cooldown_stream(replay_stream(spark, f"{tmp_path}/found"), cfg, None), tmp_path / "c")
    want = cooldown(alert_candidates(found), 30.0)
    assert want.count() > 2 and by_id(out, "device_id") == by_id(want, "device_id")
    placed = run(spark, jobs.arrival_windows_stream(replay_stream(spark, path), 10, None), tmp_path / "w")
    assert by_id(placed, "window_no", "is_late") == by_id(arrival_windows(df, 10), "window_no", "is_late")


def figures(df, *at):
    """Statistics by device, window, metric and the columns of `at`."""
    rows = df.collect()
    out = {(r["device_id"], r["window_no"], r["field"], *(r[c] for c in at)): tuple(r[c] for c in ("count", "mean", "min", "max", "std")) for r in rows}
    assert len(out) == len(rows)
    return out


def same(got, want):
    assert want and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


TIMES = ("window_start", "window_end")


def test_windows_in_event_order(spark, history, tmp_path):
    df, path = history
    out = run(spark, window_stream(replay_stream(spark, path), 10, 3, delay="5 seconds"), tmp_path)
    last = df.agg(F.max("timestamp")).first()[0]
    passed = df.filter(F.col("timestamp") <= F.lit(last) - F.expr("INTERVAL 5 SECONDS"))
    same(figures(out.filter("kind = 'window'"), *TIMES), figures(tumbling(passed, 10), *TIMES))
    same(figures(out.filter("kind = 'snapshot'"), "emitted_at", *TIMES), figures(running_snapshots(passed, 10, 3), "emitted_at", *TIMES))


@pytest.fixture(scope="module")
def unordered(spark, tmp_path_factory):
    """Events of which a third arrive long after younger ones, one file per stretch of arrival."""
    rng = random.Random(12)
    rows = [{"seconds": i * 1.5, "device_id": rng.choice("ab"), "metrics": {"temperature": rng.random(), **({"pressure": rng.random()} if i % 3 else {})}} for i in range(80)]
    for r in rows:
        r["ingested"] = r["seconds"] + rng.choice([0, 0, 14])
    df = events(spark, rows).cache()
    path = str(tmp_path_factory.mktemp("unordered"))
    at = F.unix_seconds("ingested_at") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    for low in (0, 45, 90):
        df.filter((at >= low) & (at < low + 45)).coalesce(1).write.mode("append").parquet(path)
    return df, path


def test_windows_in_order_of_arrival(spark, unordered, tmp_path):
    df, path = unordered
    out = run(spark, window_stream(replay_stream(spark, path), 10, 3, order="arrival"), tmp_path)
    placed = arrival_windows(df, 10)
    same(figures(out.filter("kind = 'window'"), *TIMES), figures(completed_arrival_windows(placed), *TIMES))
    for block in (86400.0, 20.0, 2.0):
        snapshots = arrival_snapshots(df, 10, 3, block_seconds=block)
        same(figures(out.filter("kind = 'snapshot'"), "emitted_at", *TIMES), figures(snapshots, "emitted_at", *TIMES))


def test_a_late_event_is_in_the_next_snapshot_and_in_no_window(spark, tmp_path):
    at = [(0, 0), (12, 12), (5, 13), (14, 14), (25, 25)]  # the third is older than the open window
    rows = [{"seconds": t, "ingested": i, "metrics": {"temperature": float(t)}} for t, i in at]
    df = events(spark, rows)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = run(spark, window_stream(replay_stream(spark, f"{tmp_path}/in"), 10, 2, order="arrival"), tmp_path)
    for snapshots, windows in ((out.filter("kind = 'snapshot'"), out.filter("kind = 'window'")), (arrival_snapshots(df, 10, 2), completed_arrival_windows(arrival_windows(df, 10)))):
        shown = {r["emitted_at"].second: (r["count"], r["min"], r["max"]) for r in snapshots.collect()}
        assert shown == {0: (1, 0, 0), 12: (1, 12, 12), 14: (3, 5, 14), 25: (1, 25, 25)}
        assert sorted((r["count"], r["min"], r["max"]) for r in windows.collect()) == [(1, 0, 0), (2, 12, 14)]


def test_clean_stream_into_tables(spark, history, tmp_path):
    df, path = history
    cfg = Settings(tenancy=Tenancy(enabled=True))
    events_in = jobs.clean_stream(replay_stream(spark, path), cfg)
    seen = []
    query = jobs.start_fan_out(events_in, str(tmp_path), f"{tmp_path}/state", on_batch=lambda b, n: seen.append(b.count()))
    query.awaitTermination()
    stored = jobs.flow_tables(spark, str(tmp_path))["events"].read()
    want = flow.clean(df, cfg)
    assert by_id(stored, "device_id") == by_id(want, "device_id")
    assert len(seen) >= 3 and sum(seen) == want.count()


class MapState:
    """A bucket's map state, in memory."""

    def __init__(self):
        self.cells, self.written = {}, []

    def getMapState(self, *_, **__):
        return self

    def getValue(self, key):
        return self.cells.get(key)

    def updateValue(self, key, value):
        self.cells[key] = value
        self.written.append(key)


def test_a_call_advances_all_keys_of_a_bucket_and_writes_only_theirs(spark):
    """One call a key had made a micro-batch of many devices cost far more than its rows."""
    from tidemark.operators.detectors import EwmaScore, HalfSpaceTrees
    from tidemark.streaming.keyed import KeyedRecurrence

    cfg = HalfSpace(n_trees=2, height=3, window=4)
    rng = random.Random(5)
    rows = [{"seconds": i, "device_id": rng.choice("abcd"), "metrics": {"temperature": rng.random() * 50}} for i in range(60)]
    df = events(spark, rows).withColumn("vector", F.map_values("metrics")).orderBy("timestamp")
    frame, state = df.toPandas(), MapState()
    scan = KeyedRecurrence(df.schema, ["device_id"], ["timestamp", "event_id"], [EwmaScore(Ewma(min_samples=3)), HalfSpaceTrees(cfg)], None)
    scan.init(state)
    got = {}
    for lo, hi, devices in ((0, 30, "abcd"), (30, 60, "ab")):
        part = frame[lo:hi][frame[lo:hi]["device_id"].isin(list(devices))]
        state.written = []
        (out,) = scan.handleInputRows((0,), iter([part]), None)
        got.update({r.event_id: (r.statistical, r.isolation_forest) for r in out.itertuples()})
        assert len(state.written) == len(devices)
    left = df.filter((F.col("sequence") < 30) | F.col("device_id").isin("a", "b"))
    want = by_id(sc.ewma_score(left, Ewma(min_samples=3)), "statistical")
    assert len(want) > 40 and set(got) == set(want) and any(v[0] for v in want.values())
    assert all(got[e][0] == pytest.approx(want[e][0]) for e in want)
    assert any(v[1] != 0.5 for v in got.values())


def test_events_added_one_by_one_or_at_once():
    import numpy as np

    from tidemark.streaming import windows as sw

    rng = random.Random(3)
    metrics = [{"temperature": rng.random() * 9, **({"pressure": rng.random()} if i % 3 else {})} for i in range(40)]
    times = np.arange(40)
    once, several = sw.Sums(), sw.Sums()
    once.add(times, metrics)
    for at in range(0, 40, 4):
        several.add(times[at : at + 4], metrics[at : at + 4])
    assert set(once.fields) == set(several.fields) and (once.first, once.last) == (several.first, several.last) == (0, 39)
    assert all(once.fields[k] == pytest.approx(several.fields[k], abs=1e-9) for k in once.fields)


def test_state_has_few_partitions_however_many_a_batch_join_takes(spark, tmp_path):
    spark.createDataFrame([(i % 5, i) for i in range(20)], "k long, v long").write.parquet(f"{tmp_path}/in")
    name, most = "spark.sql.shuffle.partitions", 2 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    spark.conf.set(name, str(most + 50))
    try:
        rows = replay_stream(spark, f"{tmp_path}/in", files_per_trigger=100).dropDuplicates(["k"])
        query = jobs.start_parquet(rows, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        assert spark.conf.get(name) == str(most + 50)
    finally:
        spark.conf.set(name, before)
    assert {s["numShufflePartitions"] for p in query.recentProgress for s in p["stateOperators"]} == {most}
    assert spark.read.parquet(f"{tmp_path}/out").select("k").distinct().count() == 5


def test_waiting_events_are_not_read_before_the_watermark_reaches_them():
    import pandas as pd

    from tidemark.streaming.windows import Windows

    class Waiting:
        def __init__(self):
            self.bodies, self.reads, self.timers = [], 0, []

        def appendValue(self, body):
            self.bodies.append(body)

        def get(self):
            self.reads += 1
            return list(self.bodies)

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return 1000

    windows, state = Windows(10, 2, True), Waiting()
    windows.handle = windows.waiting = state
    for first in (5_000_500, 3_000_000):
        rows = {"tenant_id": ["t"] * 2, "device_id": ["a"] * 2, "sensor_type": ["s"] * 2, "at": [first + 9, first], "event_id": ["x", "y"], "us": [first + 9, first], "metrics": [{"v": 1.0}] * 2}
        assert list(windows.handleInputRows((0,), iter([pd.DataFrame(rows)]), state)) == []
    assert (state.reads, len(state.bodies), state.timers) == (0, 2, [5001, 3000])


def test_the_pass_for_anomalies_carries_what_they_are_made_of(spark):
    from checks.queries import anomalies_of

    df = events(spark, [{"seconds": i, "device_id": "a", "metrics": {"temperature": 60.0}} for i in range(3)])
    found = anomalies_of(df.withColumn("ballast", F.lit("x")).cache())
    passes = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert passes and not any("ballast" in line or "rule_scores" in line for line in passes)


def test_rows_reach_a_keyed_processor_in_cells(spark, monkeypatch):
    """Each row had been a Python object of its own, in the processor and before it."""
    from tidemark.streaming import keyed

    rows = [{"seconds": i, "device_id": "abc"[i % 3], "event_id": f"e{i}", "metrics": {"temperature": i / 3} if i % 4 else {}, "tags": {"a": None} if i % 5 else None} for i in range(300)]
    df = events(spark, rows).withColumn("gap", F.when(F.col("sequence") % 2 == 0, F.lit(float("nan"))))
    dealt = keyed.dealt_out(df.coalesce(1), ["device_id"], 2)
    cells = dealt.mapInArrow(keyed._deal, keyed.DEALT)
    assert len({r["_bucket"] for r in cells.collect()}) == cells.count() <= 2
    back = cells.select("body").mapInArrow(keyed._spread, df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    monkeypatch.setattr(keyed, "PACK_BYTES", 1)  # a stretch is a batch of 13 rows here
    (one,) = {len(list(keyed._deal(iter([b, b])))) for b in dealt.limit(5).toArrow().to_batches()}
    assert one == 2


def test_rows_that_pass_by_a_recurrence(spark):
    import pyarrow as pa

    from tidemark.operators.spacing import Spacing
    from tidemark.streaming.keyed import KeyedRecurrence

    step = KeyedRecurrence(None, ["k"], ["t"], [Spacing("t", 10)], None, where="w")
    step.init(MapState())
    at = lambda *us: pa.array(us, pa.timestamp("us", tz="UTC"))
    made = lambda k, t, w: pa.RecordBatch.from_pydict({"k": pa.array(k), "t": t, "w": pa.array(w)})
    out = step.handle_batch(made(["b", "a", "a", "a", "b"], at(5, 20, 1, 4, 6), [False, True, True, False, True]))
    assert out.select(["k", "kept"]).to_pylist() == [{"k": "a", "kept": True}, {"k": "a", "kept": None}, {"k": "a", "kept": True}, {"k": "b", "kept": None}, {"k": "b", "kept": True}]
    out = step.handle_batch(made(["a", "c"], at(25, 25), [True, False]))
    assert out.column("kept").to_pylist() == [False, None] and out.column("prev_anchor").cast("int64").to_pylist() == [20, None]
    assert step.handle_batch(made(["c"], at(25), [False])).column("kept").to_pylist() == [None]
