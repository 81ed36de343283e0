"""The generic `events` table (event_id, ts, user_id, event_type, value, props) read as sensor events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import half_up
from tidemark.session import prepare


def _pick(industrial, vehicle, network):
    st = F.col("user_id") % 3
    return F.when(st == 0, industrial).when(st == 1, vehicle).otherwise(network)


SMALL_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate (file sizes carried through the plan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table too small to have a scan task per core is spread before the work; larger ones are read as they are."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    if estimated_bytes(events) < SMALL_BYTES:
        events = events.repartition(spark.sparkContext.defaultParallelism)
    return as_sensor_events(events)


def as_sensor_events(events: DataFrame) -> DataFrame:
    """Works on a batch or a streaming read of the table.

    Users become devices of three kinds. Some rows carry faults on purpose
    (bad ids, unknown types and fields, values out of range), and some are
    delivered again 3 and 8 seconds later.
    """
    eid, value = F.col("event_id"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = _pick(F.lit("industrial"), F.lit("vehicle"), F.lit("network"))
    v1 = half_up(
        _pick(50 + value * 0.2, value * 0.5, value * 1000.0) * F.when(eid % 83 == 0, 10.0).otherwise(1.0), 4
    )
    v2 = half_up(_pick(0.25 + k * 0.085, 2000 + k * 10.0, k * 500.0), 4)
    v3 = half_up(_pick(2 + k * 0.05 + value * 0.02, k.cast("double"), value * 0.012), 4)
    entries = [
        F.struct(_pick(F.lit("temperature"), F.lit("speed"), F.lit("bytes_in")).alias("key"), v1.alias("value")),
        F.struct(_pick(F.lit("pressure"), F.lit("engine_rpm"), F.lit("bytes_out")).alias("key"), v2.alias("value")),
        F.struct(_pick(F.lit("vibration"), F.lit("fuel_level"), F.lit("packet_loss")).alias("key"), v3.alias("value")),
    ]
    humidity = F.struct(F.lit("humidity").alias("key"), F.lit(40.0).alias("value"))
    source = F.struct(F.lit("source").alias("key"), F.col("event_type").alias("value"))
    acme = F.struct(F.lit("tenant").alias("key"), F.lit("acme").alias("value"))
    ts = F.col("ts").cast("timestamp")
    delays = F.when(eid % 40 == 0, F.array(F.lit(0), F.lit(3), F.lit(8))).when(
        eid % 20 == 0, F.array(F.lit(0), F.lit(3))
    ).otherwise(F.array(F.lit(0)))
    rows = events.select(
        eid.alias("src_id"),
        F.when(eid % 97 == 0, "bad id!")
        .otherwise(F.concat(kind, F.lit("-device-"), F.lpad(F.col("user_id").cast("string"), 4, "0")))
        .alias("device_id"),
        F.when(eid % 101 == 0, "marine").otherwise(kind).alias("sensor_type"),
        ts.alias("timestamp"),
        F.map_from_entries(
            F.when(eid % 89 == 0, F.array(*entries, humidity)).otherwise(F.array(*entries))
        ).alias("metrics"),
        F.map_from_entries(F.when(F.col("user_id") % 4 == 1, F.array(source, acme)).otherwise(F.array(source))).alias(
            "tags"
        ),
        F.when(F.col("user_id") % 4 == 2, "globex").alias("tenant_id"),
        eid.alias("sequence"),
        F.when(eid % 10 != 9, value >= 200).alias("is_anomaly"),
        F.lit(None).cast("string").alias("anomaly_label"),
        (F.unix_micros(ts) + k * 10_000).alias("_first_us"),
        F.posexplode(delays).alias("delivery", "_delay"),
    )
    return rows.withColumn(
        "ingested_at", F.timestamp_micros(F.col("_first_us") + F.col("_delay").cast("bigint") * 1_000_000)
    ).withColumn(
        "event_id", F.sha2(F.concat_ws("-", F.col("src_id").cast("string"), F.col("delivery").cast("string")), 256)
    ).drop("_first_us", "_delay")
