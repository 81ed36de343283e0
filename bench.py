"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set
input and parallelism. `value` is the sum of the query times, after a warm-up
that is not counted; the start of Spark is listed on its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "v5_split_valid",
    "d1_dedup",
    "w1_anchored_tumbling",
    "w2_running_snapshots",
    "a1_ewma",
    "a9_detect",
    "q4_list_devices",
    "b8_latency_quantiles",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def full_flow(spark, sf: str) -> int:
    """Everything the engine does with a batch: clean, store, windows, snapshots, detection, alerts."""
    from checks.queries import CFG, raw, stored
    from tidemark.plans import flow

    columns = ["event_id", "tenant_id", "device_id", "sensor_type", "timestamp", "metrics", "tags", "ingest_latency_ms"]
    out = flow.process(raw(spark, sf), CFG, store=lambda e: stored(spark, e.select(*columns), "bench-events"))
    found = stored(spark, out.anomalies, "bench-anomalies")
    drain(out.window_stats)
    drain(out.snapshots)
    from tidemark.operators.alerts import alerts

    drain(alerts(found, CFG.alerting))
    return raw(spark, sf).count()


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    start = time.time()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    from checks.queries import QUERIES

    spark.range(1).count()
    started = time.time() - start
    for name in ("d2_status", "a9_detect"):  # loads classes and starts Python workers
        drain(QUERIES[name](spark, sf))
    times = {}
    for name in HEADLINE:
        start = time.time()
        drain(QUERIES[name](spark, sf))
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    start = time.time()
    rows = full_flow(spark, sf)
    times["full_flow"] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf.rsplit("sf", 1)[-1],
                "full_flow_events_per_sec": round(rows / times["full_flow"], 1),
                "spark_start_sec": round(started, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
