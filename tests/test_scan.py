"""Ordered passes against plain loops, whole and cut into blocks of time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Ewma, HalfSpace
from tidemark.operators.dedup import dedup, duplicate_ids
from tidemark.operators.detectors import HalfSpaceTrees
from tidemark.operators.scan import number_rows
from tidemark.operators.spacing import Spacing
from tidemark.operators.split_scan import numbered, split_scan
from tidemark.operators.scoring import ewma_score, hst_score
from tidemark.operators.windows import arrival_snapshots, running_snapshots
from tests.events import by_id, events

# one block, a few, and one for nearly every row
MODES = [{}, {"block_seconds": 60.0}, {"block_seconds": 2.0}]


def hot_rows(n=150, seed=3):
    """Three devices, one of which has most of the rows; some times coincide."""
    rng = random.Random(seed)
    rows, t = [], 0.0
    for _ in range(n):
        t += rng.choice([0, 0.5, 1, 2, 7])
        device = "hot" if rng.random() < 0.8 else rng.choice(["a", "b"])
        rows.append({"seconds": t, "device_id": device, "metrics": {"temperature": 60 + rng.random() * 9}})
    return rows


def greedy(times, gap, strict):
    last, kept = None, []
    for t in times:
        keep = last is None or (t - last > gap if strict else t - last >= gap)
        kept.append(keep)
        if keep:
            last = t
    return kept


@pytest.mark.parametrize("options", MODES)
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("gap", [0, 3, 20])
def test_spacing_equals_the_loop(spark, options, strict, gap):
    rows = hot_rows()
    df = events(spark, rows).select("device_id", "timestamp", "event_id")
    spacing = Spacing("timestamp", gap * 1_000_000, strict=strict)
    got = by_id(split_scan(df, ["device_id"], ["timestamp", "event_id"], spacing, **options), "kept")
    for device in ("hot", "a", "b"):
        mine = [(r["seconds"], f"e{i:05d}") for i, r in enumerate(rows) if r["device_id"] == device]
        want = greedy([t for t, _ in mine], gap, strict)
        assert [got[e][0] for _, e in mine] == want


@pytest.mark.parametrize("options", MODES)
def test_previous_anchor_is_the_last_kept_time(spark, options):
    df = events(spark, hot_rows()).select("device_id", "timestamp", "event_id")
    out = split_scan(df, ["device_id"], ["timestamp", "event_id"], Spacing("timestamp", 3_000_000), **options)
    for device in ("hot", "a", "b"):
        anchor = None
        for r in out.filter(F.col("device_id") == device).orderBy("timestamp", "event_id").collect():
            assert r["prev_anchor"] == anchor
            if r["kept"]:
                anchor = r["timestamp"]


def ewma_loop(values, cfg):
    mean, var, out = None, 0.0, []
    for n, v in enumerate(values, 1):
        if mean is None:
            mean = v
            out.append(0.0)
            continue
        d = v - mean
        mean = cfg.alpha * v + (1 - cfg.alpha) * mean
        var = cfg.alpha * d * d + (1 - cfg.alpha) * var
        score = min(1.0, abs(v - mean) / max(var, 1e-9) ** 0.5 / cfg.z_score_threshold)
        out.append(score if n >= cfg.min_samples else 0.0)
    return out


@pytest.mark.parametrize("options", MODES)
def test_ewma_equals_the_loop(spark, options):
    cfg = Ewma(min_samples=5)
    rng = random.Random(1)
    rows = hot_rows()
    for r in rows:  # a second metric that is often missing
        if rng.random() < 0.4:
            r["metrics"]["pressure"] = rng.random()
    got = by_id(ewma_score(events(spark, rows), cfg, **options), "statistical")
    for device in ("hot", "a", "b"):
        mine = [(f"e{i:05d}", r["metrics"]) for i, r in enumerate(rows) if r["device_id"] == device]
        want = {e: 0.0 for e, _ in mine}
        for field in ("temperature", "pressure"):
            series = [(e, m[field]) for e, m in mine if field in m]
            for (e, _), s in zip(series, ewma_loop([v for _, v in series], cfg)):
                want[e] = max(want[e], s)
        for e, s in want.items():
            assert got[e][0] == pytest.approx(s, abs=1e-9)


def hst_loop(vectors, cfg):
    trees = HalfSpaceTrees(cfg)
    feature, threshold = trees.forest(len(vectors[0]))
    mass, previous, out, n = {}, None, [], 0
    for v in vectors:
        total = 0.0
        for tree in range(cfg.n_trees):
            node, open_ = 1, True
            for depth in range(cfg.height + 1):
                if previous is not None and open_:
                    m = previous.get((tree, node), 0)
                    total += m * 2**depth
                    open_ = m >= 0.1 * cfg.window
                mass[tree, node] = mass.get((tree, node), 0) + 1
                if depth < cfg.height:
                    node = 2 * node + int(v[feature[tree, node]] >= threshold[tree, node])
        raw = 0.0 if previous is None else 1 - total / (cfg.n_trees * cfg.window * (2 ** (cfg.height + 1) - 1))
        out.append(min(1.0, max(0.0, raw + 0.5)))
        n += 1
        if n % cfg.window == 0:
            previous, mass = mass, {}
    return out


@pytest.mark.parametrize("options", MODES)
def test_half_space_trees_equal_the_loop(spark, options):
    cfg = HalfSpace(n_trees=4, height=5, window=16, limits="unit")
    rng = np.random.default_rng(5)
    rows = hot_rows()
    for r in rows:
        r["metrics"] = dict(zip(("temperature", "pressure", "vibration"), rng.random(3).tolist()))
    got = by_id(hst_score(events(spark, rows), cfg, **options), "isolation_forest")
    for device in ("hot", "a", "b"):
        mine = [(f"e{i:05d}", list(r["metrics"].values())) for i, r in enumerate(rows) if r["device_id"] == device]
        for (e, _), want in zip(mine, hst_loop([v for _, v in mine], cfg)):
            assert got[e][0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("options", MODES)
def test_dedup_by_both_ways(spark, options):
    deliveries = [0, 3, 5, 5.1, 8, 10.1, 10.2, 30]
    rows = [{"seconds": 0, "ingested": s, "metrics": {"b": 1.0, "a": 2.0}, "event_id": f"x{i}"} for i, s in enumerate(deliveries)]
    rows += [{"seconds": 0, "ingested": 1, "metrics": {"a": 2.0, "b": 1.5}, "event_id": "other"}]
    dups = {r[0] for r in duplicate_ids(events(spark, rows), 5.0, **options).collect()}
    want = {f"x{i}" for i, kept in enumerate(greedy(deliveries, 5.0, True)) if not kept}
    assert dups == want == {"x1", "x2", "x4", "x5"}
    assert dedup(events(spark, rows), 5.0, **options).count() == len(rows) - len(want)


def test_dedup_key_ignores_metric_order_and_tenant(spark):
    rows = [
        {"seconds": 0, "metrics": {"b": 1.0, "a": 2.0}, "tenant_id": "t1"},
        {"seconds": 0, "ingested": 1, "metrics": {"a": 2.0, "b": 1.0}, "tenant_id": "t2"},
    ]
    assert [r[0] for r in duplicate_ids(events(spark, rows), 5.0).collect()] == ["e00001"]


def test_number_rows(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"))
    got = {r["v"]: r["n"] for r in number_rows(df, ["v"], "n", partitions=6).collect()}
    assert got == {v: v for v in range(100)}


def test_numbers_within_keys(spark):
    df = events(spark, hot_rows()).select("device_id", "timestamp", "event_id")
    for block in (2.0, 60.0, 86400.0):
        got = numbered(df, ["device_id"], ["timestamp", "event_id"], "n", block_seconds=block)
        for device in ("hot", "a", "b"):
            rows = got.filter(F.col("device_id") == device).orderBy("timestamp", "event_id").collect()
            assert [r["n"] for r in rows] == list(range(len(rows)))


def job_count(spark, group, work):
    """Jobs that `work` starts."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    work()
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setJobGroup("other", "other")
    return jobs


def test_building_a_plan_starts_no_job_and_cuts_cost_none(spark, tmp_path):
    rows = [{"seconds": 7.0 * i, "device_id": "hot", "metrics": {"temperature": 60.0 + i % 9}} for i in range(400)]
    path = str(tmp_path / "hot")
    events(spark, rows).write.parquet(path)
    df = spark.read.parquet(path)
    plans = {
        "spacing": lambda block: split_scan(df.select("device_id", "timestamp", "event_id"), ["device_id"], ["timestamp", "event_id"], Spacing("timestamp", 30_000_000), block_seconds=block),
        "ewma": lambda block: ewma_score(df, Ewma(min_samples=5), block_seconds=block),
        "trees": lambda block: hst_score(df, HalfSpace(window=16), block_seconds=block),
        "snapshots": lambda block: running_snapshots(df, 600, 60, block_seconds=block),
        "arrivals": lambda block: arrival_snapshots(df, 600, 60, block_seconds=block),
        "dedup": lambda block: duplicate_ids(df, 5.0, block_seconds=block),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive execution runs a stage as a job
    try:
        for name, plan in plans.items():
            assert job_count(spark, f"build-{name}", lambda plan=plan: plan(700.0).schema) == 0, name
            few, many = (job_count(spark, f"{name}-{block}", lambda plan=plan, block=block: plan(block).collect()) for block in (700.0, 70.0))  # 4 and 40 blocks
            assert few == many, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_partitioning_does_not_matter(spark):
    df = events(spark, hot_rows())
    one = by_id(ewma_score(df.coalesce(1), Ewma(min_samples=5)), "statistical")
    many = by_id(ewma_score(df.repartition(5, "event_id"), Ewma(min_samples=5)), "statistical")
    assert one == many
