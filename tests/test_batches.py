"""Tables of batches: each counts once, whatever is repeated or dies halfway."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.config import Alerting, Detection, Drift, HalfSpace, KafkaTopics, Settings, Tenancy
from tidemark.operators import metrics
from tidemark.operators.alerts import alert_candidates, cooldown
from tidemark.operators.metrics import newest
from tidemark.operators.scoring import detect
from tidemark.operators.windows import arrival_snapshots, arrival_windows, completed_arrival_windows
from tidemark.plans import dashboards, flow, serve
from tidemark.sinks import tables
from tidemark.sinks.batches import BatchTable, LatestTable
from tidemark.sources.kafka import kafka_rows, topic_events
from tidemark.sources.replay import replay_stream
from tidemark.streaming import jobs
from tests.events import by_id, events

GOOD = {"temperature": 65.0, "pressure": 4.5, "vibration": 3.2}
DAY = 86400


def some(spark, *days, tenant="default", first=0):
    rows = [{"seconds": d * DAY + i, "metrics": {**GOOD, "temperature": float(i)}, "tenant_id": tenant, "event_id": f"{tenant}-{d}-{first + i}"} for d in days for i in range(first, first + 3)]
    return events(spark, rows)


def ids(df):
    found = sorted(r["event_id"] for r in df.select("event_id").collect())
    assert len(found) == len(set(found))
    return found


@pytest.fixture()
def table(spark, tmp_path):
    return BatchTable(spark, str(tmp_path / "events"), key=("event_id", "timestamp"))


def test_a_batch_counts_once(spark, table):
    a, b = some(spark, 0, 1), some(spark, 1, 2, tenant="a/b c")
    assert table.write("1", a) and not table.write("1", b)
    assert ids(table.read()) == ids(a)
    # rows of an earlier batch are not stored again, new ones of the same day are
    assert table.write("2", a.unionByName(b).unionByName(some(spark, 1, first=3)))
    assert ids(table.read()) == ids(a.unionByName(b).unionByName(some(spark, 1, first=3)))
    assert ids(table.read(tenants=["a/b c"])) == ids(b)
    assert table.write("3", a.limit(0)) and len(table.manifests()) == 3
    with pytest.raises(ValueError):
        table.write("../x", a)


def test_an_attempt_that_died_is_not_seen(spark, table):
    table.write("1", some(spark, 0))
    died = tables.dated(some(spark, 0, 1, first=5))
    died.write.partitionBy("tenant_id", "date").parquet(f"{table.path}/batch=2")  # no manifest
    assert ids(table.read()) == ids(some(spark, 0))
    assert table.write("2", some(spark, 1))
    assert ids(table.read()) == ids(some(spark, 0).unionByName(some(spark, 1)))


def test_a_null_tenant_and_a_null_time_have_folders(spark, table):
    df = some(spark, 0).withColumn("tenant_id", F.lit(None).cast("string")).unionByName(some(spark, 1))
    df = df.unionByName(some(spark, 2).withColumn("timestamp", F.lit(None).cast("timestamp")))
    table.write("1", df)
    table.write("2", df)
    assert ids(table.read()) == ids(df)


def opened(df):
    return {f.split("/events/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}


def test_readers_open_the_folders_they_need(spark, table):
    table.write("1", some(spark, 0, 1, 2))
    table.write("2", some(spark, 1, 40, tenant="acme"))
    assert opened(table.read(since="2024-01-02", until="2024-01-02 23:00:00")) == {"batch=1/tenant_id=default/date=2024-01-02", "batch=2/tenant_id=acme/date=2024-01-02"}
    assert opened(table.read(tenants=["acme"])) == {"batch=2/tenant_id=acme/date=2024-01-02", "batch=2/tenant_id=acme/date=2024-02-10"}
    assert len(ids(table.read(since="2024-01-02 00:00:01", until="2024-01-03"))) == 4


def test_compaction_swaps_once_and_keeps_the_rows(spark, table):
    batches = [some(spark, 0, 1, 9), some(spark, 0, 1, tenant="acme"), some(spark, 1, first=3)]
    for i, b in enumerate(batches):
        table.write(str(i), b)
    before = by_id(table.read(), "device_id", "timestamp", "metrics", "tenant_id")
    assert table.compact("c-1", 2, "2024-01-06 00:00:00")
    assert by_id(table.read(), "device_id", "timestamp", "metrics", "tenant_id") == before
    assert not table.compact("c-1", 2, "2024-01-06 00:00:00")
    assert by_id(table.read(), "device_id", "timestamp", "metrics", "tenant_id") == before
    # late rows of a compacted day, repeated ones left out; then compacted again
    table.write("4", some(spark, 1, first=3).unionByName(some(spark, 1, first=6)))
    assert table.compact("c-2", 2, "2024-01-06 00:00:00")
    want = {**before, **by_id(some(spark, 1, first=6), "device_id", "timestamp", "metrics", "tenant_id")}
    assert by_id(table.read(), "device_id", "timestamp", "metrics", "tenant_id") == want
    assert opened(table.read(until="2024-01-03")) == {f"batch=c-2/tenant_id={t}/date=2024-01-0{d}" for t in ("default", "acme") for d in (1, 2)}
    gone = table.vacuum()
    assert "batch=c-1" in gone and "batch=0/tenant_id=default/date=2024-01-01" in gone and table.vacuum() == []
    assert by_id(table.read(), "device_id", "timestamp", "metrics", "tenant_id") == want
    assert not glob.glob(f"{table.path}/batch=1")


def test_plain_tables_open_the_days_of_a_batch_and_compact_twice(spark, tmp_path):
    path, target = str(tmp_path / "plain"), str(tmp_path / "packed")
    tables.write_events(some(spark, 0, 1), path)
    broken = glob.glob(f"{path}/tenant_id=default/date=2024-01-01/*.parquet")
    for f in broken:  # a day that the next batch does not touch is not opened
        os.rename(f, f + ".away")
    tables.write_events(some(spark, 1).unionByName(some(spark, 2)), path)
    for f in broken:
        os.rename(f + ".away", f)
    assert ids(spark.read.parquet(path)) == ids(some(spark, 0, 1, 2))
    for _ in range(2):
        tables.compact(spark, path, target, 1, "2024-01-04 00:00:00")
        assert by_id(spark.read.parquet(target), "timestamp", "metrics") == by_id(some(spark, 0, 1), "timestamp", "metrics")


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Two devices with two sensor types each, some events late, in three files."""
    rows = []
    for i in range(120):
        metrics = {"temperature": 60.0 + (i * 37) % 60, "pressure": 4.0, "vibration": (i * 7) % 30 + 0.5}
        kind = "industrial" if i % 3 else "vehicle"
        if kind == "vehicle":
            metrics = {"speed": float((i * 53) % 200), "engine_rpm": 2000.0 + i, "fuel_level": 50.0}
        if i % 11 == 5:
            metrics["temperature" if kind == "industrial" else "speed"] = 5000.0  # out of range
        rows.append({"seconds": i * 1.0, "ingested": i + (0.5 if i % 5 else 0.9), "device_id": "ab"[i % 2], "sensor_type": kind, "metrics": metrics})
    df = events(spark, rows).cache()
    path = str(tmp_path_factory.mktemp("flow"))
    at = F.unix_seconds("ingested_at") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    for low in (0, 40, 80):
        df.filter((at >= low) & (at < low + 40)).coalesce(1).write.mode("append").parquet(path)
    return df, path


CFG = Settings(
    tenancy=Tenancy(enabled=True),
    detection=Detection(trees=HalfSpace(n_trees=3, height=4, window=8), drift=Drift(check_interval_seconds=0)),
    alerting=Alerting(cooldown_seconds=15),
)


def run(queries):
    for q in queries.values():
        q.awaitTermination()


def test_the_whole_flow_as_a_stream(spark, history, tmp_path):
    df, path = history
    out = str(tmp_path / "out")
    run(jobs.start_flow(replay_stream(spark, path), out, f"{tmp_path}/first", cfg=CFG, stream="s"))
    found = jobs.flow_tables(spark, out)
    clean = flow.clean(df, CFG)
    assert by_id(found["events"].read(), "device_id", "metrics") == by_id(clean, "device_id", "metrics")
    scores = lambda d: {k: (pytest.approx(s), w) for k, (s, w) in by_id(d, "score", "severity").items()}
    anomalies = detect(clean, CFG.detection)
    assert len(scores(anomalies)) > 10 and by_id(found["anomalies"].read(), "score", "severity") == scores(anomalies)
    assert by_id(found["alerts"].read(), "device_id") == by_id(cooldown(alert_candidates(anomalies), 15.0), "device_id")
    shape = lambda d, *c: sorted((r["device_id"], r["sensor_type"], r["window_no"], r["field"], r["count"], round(r["mean"], 9), *(r[x] for x in c)) for r in d.collect())
    windows = found["window_stats"].read()
    assert shape(windows.filter("kind = 'window'")) == shape(completed_arrival_windows(arrival_windows(clean, 10)))
    assert shape(windows.filter("kind = 'snapshot'"), "emitted_at") == shape(arrival_snapshots(clean, 10, 2), "emitted_at")

    # all micro-batches once more: the same rows and values in every table
    rows = {name: sorted(map(str, t.read().collect())) for name, t in found.items()}
    run(jobs.start_flow(replay_stream(spark, path), out, f"{tmp_path}/again", cfg=CFG, stream="s"))
    assert {name: sorted(map(str, t.read().collect())) for name, t in found.items()} == rows


def test_topics_into_the_flow(spark, history, tmp_path):
    df, _ = history
    cfg = KafkaTopics(topic_per_tenant=True)
    sent = kafka_rows(df.withColumn("tenant_id", F.lit("acme")), cfg, Tenancy(enabled=True))
    rows = sent.withColumn("value", F.regexp_replace("value", ',"tenant_id":"acme"', "")).withColumn("partition", F.lit(3))
    rows = rows.withColumn("offset", F.xxhash64("value")).withColumn("ingested_at", F.lit("2024-01-02").cast("timestamp"))
    rows = rows.unionByName(rows.limit(1).withColumn("value", F.lit("{")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/topic")
    parsed, rejects = topic_events(replay_stream(spark, f"{tmp_path}/topic"), cfg)
    events_in = jobs.clean_stream(parsed, CFG)
    jobs.start_fan_out(events_in, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    stored = jobs.flow_tables(spark, f"{tmp_path}/out")["events"].read()
    assert {r["tenant_id"] for r in stored.collect()} == {"acme"} and len(ids(stored)) == flow.clean(df, CFG).count()
    assert "reject_reason" in rejects.columns


def test_live_counters_equal_the_batch(spark, history, tmp_path):
    from tidemark.operators.metrics import event_counters
    from tidemark.streaming.counters import LiveCounters, settle

    df, path = history
    listener = LiveCounters()
    spark.streams.addListener(listener)
    try:
        queries = jobs.start_flow(replay_stream(spark, path), f"{tmp_path}/out", f"{tmp_path}/state", cfg=CFG)
        run(queries)
        settle(spark)
    finally:
        spark.streams.removeListener(listener)
    checked = flow.with_tenant(flow.check(df, CFG), CFG)
    want = event_counters(checked, detect(flow.clean(df, CFG), CFG.detection)).first().asDict()
    assert want["events_invalid"] > 0 and listener.totals() == want
    events_of = [r for r in listener.batches() if r[0] == str(queries["events"].id)]
    assert [r[2] for r in events_of] == [40, 40, 40]  # ingested by micro-batch
    # what the dashboard reads, after three micro-batches
    latest = jobs.snapshot_tables(spark, f"{tmp_path}/out")
    clean = flow.clean(df, CFG)
    assert by_id(latest["events"].read(), "metrics") == by_id(clean, "metrics")
    assert len(latest["events"].manifests()) >= 3


def test_latest_rows_of_each_tenant(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path / "latest"), n=4, order=("timestamp", "event_id"), key=("event_id", "timestamp"))
    batches = [some(spark, 0, 1).unionByName(some(spark, 5, tenant="acme")), some(spark, 0, 2), some(spark, 9, tenant="acme").unionByName(some(spark, 2))]
    seen = None
    for i, b in enumerate(batches):
        seen = b if seen is None else seen.unionByName(b)
        for _ in range(2):  # the second time changes nothing
            table.write(str(i), b)
        want = newest(seen.dropDuplicates(["event_id"]), ["tenant_id"], 4, ["timestamp", "event_id"])
        assert by_id(table.read(), "tenant_id", "metrics") == by_id(want, "tenant_id", "metrics")
    assert table.vacuum() and ids(table.read()) == ids(want)


def test_newest_rows_open_the_newest_dates(spark, table):
    table.write("1", some(spark, *range(12)))
    table.write("2", some(spark, 10, tenant="acme"))
    everything = table.read()
    for limit, dates in ((2, 1), (3, 1), (4, 2), (10, 4), (30, 12), (100, 12)):
        got = serve.newest_first(table, serve.recent_events, limit, "default")
        want = serve.recent_events(everything, limit, "default")
        assert [r["event_id"] for r in got.collect()] == [r["event_id"] for r in want.collect()]
        assert len(opened(got)) == dates
    assert opened(serve.newest_first(table, serve.recent_events, 2, "acme")) == {"batch=2/tenant_id=acme/date=2024-01-11"}
    rare = serve.newest_first(table, serve.recent_events, 1, None, "nobody")
    assert rare.count() == 0


def test_old_dates_are_not_read(spark, tmp_path):
    path = str(tmp_path / "plain")
    tables.write_append(some(spark, 0, 1, 2, 3), path)
    at = F.lit("2024-01-03 12:00:00").cast("timestamp")
    for df in (dashboards.since(spark.read.parquet(path), at, "24 hours"), tables.retained(spark.read.parquet(path), 1, at)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date" in plan
    assert dashboards.event_count(spark.read.parquet(path), at, "24 hours").first()[0] == 3


def test_sketches_add_up_and_are_near(spark):
    rows = [(g, float(v)) for g, f in (("a", lambda i: 1.5**(i % 60)), ("b", lambda i: (i * 7919 % 4001) / 7 + 0.01), (None, lambda i: 3.0)) for v in map(f, range(2000))]
    df = spark.createDataFrame(rows + [("a", None), ("c", -5.0), ("c", 0.0)], "g string, v double").repartition(4)
    whole = {r["g"]: r for r in metrics.sketch_quantiles(metrics.quantile_sketch(df, "v", ["g"]), (0.5, 0.95), ["g"]).collect()}
    parts = [metrics.quantile_sketch(df.filter(F.pmod(F.xxhash64("v"), F.lit(3)) == i), "v", ["g"]) for i in range(3)]
    added = metrics.merged_sketch(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"])
    got = {r["g"]: r for r in metrics.sketch_quantiles(added, (0.5, 0.95), ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        values = sorted(v for k, v in [*rows, ("c", -5.0), ("c", 0.0)] if k == g)
        assert got[g]["samples"] == len(values) and got[g]["mean"] == pytest.approx(sum(values) / len(values))
        for f in (0.5, 0.95):
            exact = values[int((len(values) - 1) * f)]
            assert got[g][f"p{f * 100:g}"] == pytest.approx(whole[g][f"p{f * 100:g}"]) and abs(got[g][f"p{f * 100:g}"] - exact) <= abs(exact) * 0.0028


def test_four_micro_batches_are_spread_over_the_cores(spark, tmp_path):
    """Each had been one file, written by one task that read a quarter of the table."""
    from pathlib import Path

    from checks.queries import four_batches

    df, sizes = spark.range(1000), []
    stream = four_batches(spark, df, f"{tmp_path}/in")
    stream.writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(list(Path(f"{tmp_path}/in").glob("*.parquet"))) == 4 * spark.sparkContext.defaultParallelism
    assert len(sizes) == 4 and sum(sizes) == 1000


def test_a_batch_is_worked_out_once_and_its_repeated_keys_go_by_what_was_written(spark, table):
    """Its rows had been worked out for their folders, and all shuffled for their keys."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    a, b = some(spark, 0, 1), some(spark, 1, 2, tenant="acme")
    both = a.unionByName(a).unionByName(b)
    assert table.write("1", both.mapInArrow(counted, both.schema))
    assert seen.value == both.count() and ids(table.read()) == ids(a.unionByName(b))
    assert ids(table.stored("1")) == ids(table.read())
    # all rows stored before, but for one day
    assert table.write("2", a.unionByName(some(spark, 3))) and ids(table.stored("2")) == ids(some(spark, 3))
    assert table.write("3", a) and table.stored("3") is None and not glob.glob(f"{table.path}/_once-*")
    assert ids(table.read()) == ids(a.unionByName(b).unionByName(some(spark, 3)))


def test_one_row_of_each_key_however_many_are_repeated(spark, monkeypatch):
    from tidemark.sinks import batches

    rows = spark.createDataFrame([(i % 7 if i % 5 else None, i // 7 % 2, i) for i in range(40)], "a long, b long, i long")
    want = {(r["a"], r["b"]) for r in rows.collect()}
    for few in (100, 3):
        monkeypatch.setattr(batches, "FEW_KEYS", few)
        got = [(r["a"], r["b"]) for r in batches.once(rows, ["a", "b"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert batches.once(rows, ["i"]) is rows


def test_only_the_newest_dates_are_sorted_for_the_latest_rows(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path / "latest"), n=4, order=("timestamp", "event_id"), key=("event_id", "timestamp"))
    timeless = some(spark, 3, tenant="acme").withColumn("timestamp", F.lit(None).cast("timestamp"))
    rows = some(spark, *range(6)).unionByName(timeless).unionByName(some(spark, 2, first=50).withColumn("tenant_id", F.lit(None).cast("string")))
    recent = table._recent(tables.dated(rows))
    dates = {(r["tenant_id"], str(r["date"])) for r in recent.select("tenant_id", "date").collect()}
    assert dates == {("default", "2024-01-06"), ("default", "2024-01-05"), ("acme", "None"), (None, "2024-01-03")}
    table.write("1", rows)
    want = newest(rows, ["tenant_id"], 4, ["timestamp", "event_id"])
    assert sorted((r["tenant_id"] or "", r["event_id"]) for r in table.read().collect()) == sorted((r["tenant_id"] or "", r["event_id"]) for r in want.collect())


def test_anomalies_and_alerts_are_found_once(spark, history, tmp_path):
    """Alerts had read, cleaned and scored all events again."""
    _, path = history
    queries = jobs.start_flow(replay_stream(spark, path), f"{tmp_path}/out", f"{tmp_path}/state", cfg=CFG)
    run(queries)
    assert sorted(queries) == ["alerts", "anomalies", "events", "window_stats"] and len({q.id for q in queries.values()}) == 3
    found = {n: t.read() for n, t in jobs.flow_tables(spark, f"{tmp_path}/out").items()}
    kept = by_id(cooldown(alert_candidates(found["anomalies"]), 15.0), "device_id")
    assert 0 < len(kept) < found["anomalies"].count() and by_id(found["alerts"], "device_id") == kept
    assert "payload" in found["alerts"].columns and not {*jobs.MARKS} & {*found["alerts"].columns, *found["anomalies"].columns}
