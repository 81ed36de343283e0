"""Windows against a plain simulation of one event after the other."""

import datetime as dt
import random
import statistics

import pytest

from tidemark.operators import windows as wi
from tests.events import T0, events


def simulate(rows, size, slide, order):
    """Completed windows and snapshots of each device, event by event."""
    completed, snapshots, state, last = {}, [], {}, {}
    for i in sorted(range(len(rows)), key=order):
        r = rows[i]
        d, t = r["device_id"], r["seconds"]
        start, buffer = state.get(d, (t, []))
        buffer = buffer + [r]
        while t >= start + size:
            done = [e for e in buffer if start <= e["seconds"] < start + size]
            if done:
                completed[d, start] = done
            start += size
            buffer = [e for e in buffer if e["seconds"] >= start]
        state[d] = (start, buffer)
        if d not in last or t - last[d] >= slide:
            last[d] = t
            snapshots.append((d, t, buffer))
    return completed, snapshots


def stats_of(rows):
    out = {}
    for f in {f for r in rows for f in r["metrics"]}:
        v = [r["metrics"][f] for r in rows if f in r["metrics"]]
        times = [r["seconds"] for r in rows]
        out[f] = (len(v), statistics.fmean(v), min(v), max(v), statistics.pstdev(v), min(times), max(times))
    return out


def seconds(t: dt.datetime) -> float:
    return (t - T0.replace(tzinfo=None)).total_seconds()


def row_stats(r):
    return (r["count"], r["mean"], r["min"], r["max"], r["std"], seconds(r["window_start"]), seconds(r["window_end"]))


def sample(n=120, seed=9):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for _ in range(n):
        t += rng.choice([0, 0.5, 1, 1, 3, 25])
        metrics = {"temperature": 60 + rng.random()}
        if rng.random() < 0.6:
            metrics["pressure"] = rng.random()
        rows.append({"seconds": t, "device_id": rng.choice(["a", "a", "a", "b"]), "metrics": metrics})
    return rows


def test_tumbling_equals_the_simulation(spark):
    rows = sample()
    completed, _ = simulate(rows, 10, 2, lambda i: (rows[i]["seconds"], i))
    want = {(d, min(e["seconds"] for e in w), f): s for (d, _), w in completed.items() for f, s in stats_of(w).items()}
    got = {(r["device_id"], seconds(r["window_start"]), r["field"]): row_stats(r) for r in wi.tumbling(events(spark, rows), 10).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("options", [{}, {"block_seconds": 40.0}, {"block_seconds": 3.0}])
def test_snapshots_equal_the_simulation(spark, options):
    rows = sample()
    _, snapshots = simulate(rows, 10, 2, lambda i: (rows[i]["seconds"], i))
    want = {(d, t, f): s for d, t, buffer in snapshots for f, s in stats_of(buffer).items()}
    out = wi.running_snapshots(events(spark, rows), 10, 2, **options).collect()
    got = {(r["device_id"], seconds(r["emitted_at"]), r["field"]): row_stats(r) for r in out}
    assert len(got) == len(out) and set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_aggregates_of_five_values(spark):
    rows = [{"seconds": i, "metrics": {"temperature": 60.0 + i}} for i in range(5)]
    (r,) = wi.tumbling(events(spark, rows), 10, emit_open=True).collect()
    assert row_stats(r) == pytest.approx((5, 62, 60, 64, 2**0.5, 0, 4))


@pytest.mark.parametrize("mode", [{}, {"block_seconds": 30.0}, {"block_seconds": 3.0}])
def test_arrival_order_and_late_events(spark, mode):
    rng = random.Random(4)
    rows = [{"seconds": i * 1.5, "device_id": rng.choice("ab"), "metrics": {"temperature": float(i)}} for i in range(60)]
    for i, r in enumerate(rows):
        r["ingested"] = r["seconds"] + rng.choice([0, 0, 0, 14])
    completed, _ = simulate(rows, 10, 10, lambda i: (rows[i]["ingested"], i))
    placed = wi.arrival_windows(events(spark, rows), 10, **mode)
    out = wi.completed_arrival_windows(placed).collect()
    got = sorted((r["device_id"], r["count"], r["mean"]) for r in out)
    want = sorted((d, len(w), statistics.fmean(e["metrics"]["temperature"] for e in w)) for (d, _), w in completed.items())
    assert got == pytest.approx(want) if not want else [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert placed.filter("is_late").count() > 0


@pytest.mark.parametrize("options", [{}, {"block_seconds": 30.0}, {"block_seconds": 3.0}])
def test_snapshots_in_order_of_arrival(spark, options):
    rng = random.Random(8)
    rows = sample()
    for r in rows:
        r["ingested"] = r["seconds"] + rng.choice([0, 0, 0, 9, 30])
    _, snapshots = simulate(rows, 10, 2, lambda i: (rows[i]["ingested"], i))
    want = {(d, t, f): s for d, t, buffer in snapshots for f, s in stats_of(buffer).items()}
    out = wi.arrival_snapshots(events(spark, rows), 10, 2, **options).collect()
    got = {(r["device_id"], seconds(r["emitted_at"]), r["field"]): row_stats(r) for r in out}
    assert len(got) == len(out) and set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_hopping_counts_each_event_once_per_overlap(spark):
    df = events(spark, sample())
    hop = wi.window_stats_aligned(df, "10 seconds", "5 seconds").groupBy("field").sum("count").collect()
    flat = wi.window_stats_aligned(df, "10 seconds").groupBy("field").sum("count").collect()
    assert {r[0]: r[1] for r in hop} == {r[0]: 2 * r[1] for r in flat}


def test_rows_are_spread_before_they_become_many_groups(spark):
    """A task's groups had grown with the table: its rows were not split before the metrics and hops of each."""
    rows = [{"seconds": i * 1800.0, "device_id": "ab"[i % 2], "metrics": {"temperature": float(i), "pressure": 1.0}} for i in range(48)]
    df = events(spark, rows)
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    hopping = wi.window_stats_aligned(df, "6 hours", "1 hour")
    closed = wi.completed_arrival_windows(wi.arrival_windows(df, 7200))
    assert "Union" in plan(hopping) and "Expand" not in plan(hopping) and "RebalancePartitions" in plan(closed)
    assert wi._hops("6 hours", "90 minutes") == [0, 5400, 10800, 16200] and wi._hops("1 hour", "25 minutes") == [] == wi._hops("1 month", "1 day")
    got = {(r["device_id"], r["window_start"].timestamp(), r["field"]): (r["count"], r["mean"]) for r in hopping.collect()}
    want = {}
    for r in rows:
        hour = (T0.timestamp() + r["seconds"]) // 3600 * 3600
        for h in range(6):
            for field, v in r["metrics"].items():
                want.setdefault((r["device_id"], hour - h * 3600, field), []).append(v)
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(sum(v) / len(v)) for k, v in want.items())


def test_snapshots_look_for_emissions_before_any_join(spark):
    """The ordered pass reads its input twice, so the join that numbers windows comes after it, once."""
    out = wi.running_snapshots(events(spark, sample()), 10, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.index("Join Inner") < plan.index("MapInArrow")  # above the pass
