"""Registered queries: one or more per operator, each over the whole events table.

`ORACLE` holds the SQL that must give the same rows; operators that SQL cannot
follow (trees, networks, adaptive windows) have none and are tested against
brute force in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracles import sql
from tidemark.config import (
    DEFAULT_CATALOG,
    Alerting,
    Autoencoder,
    Detection,
    Drift,
    Evaluation,
    HalfSpace,
    KafkaTopics,
    Settings,
    Tenancy,
)
from tidemark.functions.expr import fixed2, half_up, parse_ts
from tidemark.operators import alerts as al
from tidemark.operators import evaluate as ev
from tidemark.operators import metrics as me
from tidemark.operators import scoring as sc
from tidemark.operators import validate as va
from tidemark.operators import windows as wi
from tidemark.operators.dedup import dedup, mark_duplicates
from tidemark.operators.enrich import (
    deviations,
    enrich,
    for_tenant,
    metric_vector,
    metrics_long,
    resolve_tenant,
    tenant_of,
)
from tidemark.operators.detectors import FrozenModels
from tidemark.plans import dashboards as da
from tidemark.plans import flow
from tidemark.plans.evaluation import evaluate_csv, write_report
from tidemark.plans import serve as se
from tidemark.session import prepare, scratch
from tidemark.sinks import tables
from tidemark.sinks.batches import BatchTable
from tidemark.sources.event_table import as_sensor_events, sensor_events
from tidemark.sources.inject import inject_anomalies
from tidemark.sources.json_events import parse_events
from tidemark.sources.kafka import kafka_rows, stamp_tenant, tenant_from_topic, topic_for_tenant
from tidemark.sources.labeled_csv import read_labeled_csv
from tidemark.sources.replay import replay_stream
from tidemark.streaming import jobs
from tidemark.streaming.counters import LiveCounters, settle
from tidemark.streaming.windows import window_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TENANCY = Tenancy(enabled=True)
CFG = Settings(tenancy=TENANCY, window_size_seconds=6 * 3600, slide_interval_seconds=3600)
# the ensemble over the two methods that SQL can follow
CHECKED = Detection(weights={"statistical": 0.7, "rule_based": 0.3})
FULL = Detection(trees=HalfSpace(window=16))
AS_OF = "2024-01-20 12:00:00"
BUCKET = "6 hours"
TOPICS = KafkaTopics(topic_per_tenant=True, tenant_topics={"globex": "globex.custom"})


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return fn

    return register


def ntz(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def r6(c: Column | str) -> Column:
    return half_up(F.col(c) if isinstance(c, str) else c, 6)


# Means of values with four decimals often end exactly halfway between two
# rounded values, and the order of summation then decides. This nudge, far
# above the summation error and far below the distance to any other mean,
# settles the tie the same way on both sides.
NUDGE = 1e-10


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def raw(spark, sf) -> DataFrame:
    return sensor_events(spark, sf)


def classified(spark, sf) -> DataFrame:
    return flow.with_tenant(flow.check(raw(spark, sf), CFG), CFG)


def valid(spark, sf) -> DataFrame:
    """Valid events with their tenant."""
    return classified(spark, sf).filter("is_valid")


def anomalies(spark, sf) -> DataFrame:
    return anomalies_of(stored_valid(spark, sf))


def anomalies_of(events: DataFrame) -> DataFrame:
    """Rules follow the ordered pass, which carries only the columns that anomalies are made of."""
    narrow = events.select("event_id", *sc.SENSOR, "timestamp", "metrics")
    return sc.ensemble(sc.with_rules(sc.ewma_score(narrow, CHECKED.ewma)), CHECKED)


def stored(spark, df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, for queries that read it more than once."""
    out = scratch(spark, name)
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


SLIM = ["event_id", "tenant_id", "device_id", "sensor_type", "timestamp", "ingested_at", "metrics", "is_anomaly"]


def stored_valid(spark, sf) -> DataFrame:
    """The valid events as a table, for operators that read their input more than once."""
    return stored(spark, valid(spark, sf).select(*SLIM), "valid")


def checked_and_found(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Classified events, cleaned once, and the anomalies among the valid ones."""
    flags = ["ingest_latency_ms", "is_invalid", "is_deduped", "is_valid"]
    events = stored(spark, classified(spark, sf).select(*SLIM, *flags), "classified")
    return events, anomalies_of(events.filter("is_valid"))


def labelled_and_found(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = stored(spark, valid(spark, sf).select(*SLIM), "valid")
    return events, anomalies_of(events)


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as DuckDB has them."""
    return df.select(*[ntz(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


# sources ---------------------------------------------------------------------


def wire(events: DataFrame) -> DataFrame:
    """Sensor events as JSON text, some of it damaged: cut short, numbers in quotes, a metric that is a word."""
    n = F.col("src_id")
    body = F.to_json(
        F.struct(
            "device_id", "sensor_type", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            "metrics", "sequence", "tags", "tenant_id", "is_anomaly", F.lit("ignored").alias("unknown_key"),
        )
    )
    quoted = F.regexp_replace(body, '"sequence":(\\d+)', '"sequence":"$1"')
    word = F.regexp_replace(body, '"(temperature|speed|bytes_in)":[-0-9.E]+', '"$1":"broken"')
    nameless = F.regexp_replace(body, '"device_id":"[^"]*",', "")
    value = (
        F.when(n % 53 == 0, F.substring(body, F.lit(1), F.length(body) - 20))
        .when(n % 59 == 0, word)
        .when(n % 61 == 0, nameless)
        .when(n % 7 == 0, quoted)
        .otherwise(body)
    )
    topic = topic_for_tenant(tenant_of(TENANCY), TOPICS)
    return events.select("event_id", "ingested_at", "src_id", topic.alias("topic"), value.alias("value"))


@query(
    "src1_json_events",
    """SELECT event_id, CASE WHEN src_id % 53 = 0 OR src_id % 59 = 0 OR src_id % 61 = 0 THEN 'reject' ELSE 'event' END AS outcome,
      CASE WHEN outcome = 'event' THEN device_id END AS device_id, CASE WHEN outcome = 'event' THEN ts END AS at,
      CASE WHEN outcome = 'event' THEN round(v1, 6) END AS first_metric, CASE WHEN outcome = 'event' THEN seq END AS sequence,
      CASE WHEN outcome = 'event' THEN tenant_id END AS tenant_id, CASE WHEN outcome = 'event' THEN is_anomaly END AS is_anomaly
    FROM ev""",
)
def src1(spark, sf):
    events, rejects = parse_events(wire(raw(spark, sf)))
    good = events.select(
        "event_id", F.lit("event").alias("outcome"), "device_id", ntz("timestamp").alias("at"),
        r6(sc.primary_metric()).alias("first_metric"), "sequence", "tenant_id", "is_anomaly",
    )
    bad = rejects.select("event_id", F.lit("reject").alias("outcome"))
    return good.unionByName(bad, allowMissingColumns=True)


def streamed(spark, df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all there is and reads back what it wrote."""
    out = scratch(spark, name)
    schema = df.schema
    jobs.start_parquet(df, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data")


def event_stream(spark, sf) -> DataFrame:
    """The table as a stream; a file source takes a folder or a pattern, not a single file."""
    return as_sensor_events(replay_stream(spark, f"{sf}/event[s].parquet"))


@query(
    "src2_topic_stream",
    """SELECT event_id, device_id, coalesce(tenant_id, tag_tenant, 'default') AS tenant_id FROM ev
    WHERE src_id % 53 <> 0 AND src_id % 59 <> 0 AND src_id % 61 <> 0""",
)
def src2(spark, sf):
    events, _ = parse_events(wire(event_stream(spark, sf)))
    stamped = stamp_tenant(events, TOPICS)
    return streamed(spark, stamped.select("event_id", "device_id", "tenant_id"), "topic-stream")


TOPIC_SQL = "CASE coalesce(tag_tenant, tenant_id, 'default') WHEN 'globex' THEN 'globex.custom' ELSE 'telemetry.events.' || coalesce(tag_tenant, tenant_id, 'default') END"


@query("src3_topic_for_tenant", f"SELECT {TOPIC_SQL} AS topic, count(*) AS n FROM ev GROUP BY 1")
def src3(spark, sf):
    topic = topic_for_tenant(tenant_of(TENANCY), TOPICS)
    return raw(spark, sf).groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src4_tenant_from_topic",
    """SELECT topic, CASE WHEN topic LIKE 'telemetry.events.%' THEN nullif(substr(topic, 18), '') END AS tenant, count(*) AS n
    FROM (SELECT CASE src_id % 3 WHEN 0 THEN 'telemetry.events.' || source_tag WHEN 1 THEN 'other.' || source_tag
            ELSE 'telemetry.events.' END AS topic FROM ev) GROUP BY 1, 2""",
)
def src4(spark, sf):
    n, tag = F.col("src_id") % 3, F.col("tags")["source"]
    topic = F.when(n == 0, F.concat(F.lit("telemetry.events."), tag)).when(n == 1, F.concat(F.lit("other."), tag))
    df = raw(spark, sf).select(topic.otherwise("telemetry.events.").alias("topic"))
    return df.groupBy("topic", tenant_from_topic(F.col("topic"), TOPICS.topic_template).alias("tenant")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "src5_stamp_tenant",
    """SELECT event_id, coalesce(tenant_id, source_tag) AS tenant_id, CASE WHEN tenant_id IS NULL THEN source_tag END AS tag,
      coalesce(tenant_id <> source_tag, false) AS tenant_mismatch FROM ev""",
)
def src5(spark, sf):
    df = raw(spark, sf).withColumn("topic", F.concat(F.lit("telemetry.events."), F.col("tags")["source"]))
    return stamp_tenant(df, TOPICS).select(
        "event_id", "tenant_id", F.try_element_at("tags", F.lit("tenant_id")).alias("tag"), "tenant_mismatch"
    )


@query(
    "src6_parse_ts",
    """SELECT event_id, CASE src_id % 5 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts)
      WHEN 3 THEN ts - INTERVAL 2 HOUR END AS at FROM ev""",
)
def src6(spark, sf):
    n, iso = F.col("src_id") % 5, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(n == 0, F.concat(iso, F.lit("Z")))
        .when(n == 1, iso)
        .when(n == 2, F.unix_seconds("timestamp").cast("string"))
        .when(n == 3, F.concat(iso, F.lit("+02:00")))
        .otherwise("yesterday")
    )
    return raw(spark, sf).select("event_id", ntz(parse_ts(text)).alias("at"))


METRICS = [f for t in DEFAULT_CATALOG.sensor_types.values() for f in t.fields] + ["humidity"]


def wide_csv(spark, sf) -> str:
    """All readings as a wide CSV, a column for each metric of any sensor type."""
    out = scratch(spark, "wide-csv")
    raw(spark, sf).select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        *[F.col("metrics")[f].alias(f) for f in METRICS],
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
    ).write.csv(out, header=True)
    return out


@query(
    "src7_labeled_csv",
    """SELECT row_number() OVER (ORDER BY ts, src_id) - 1 AS sequence, ts AS at, CASE WHEN f1 = 'temperature' THEN round(v1, 6) END AS temperature,
      CASE WHEN f2 = 'engine_rpm' THEN round(v2::DOUBLE, 6) END AS engine_rpm, CASE WHEN f3 = 'packet_loss' THEN round(v3::DOUBLE, 6) END AS packet_loss,
      CAST(3 + CAST(has_humidity AS INT) AS INT) AS readings, is_anomaly, CASE WHEN is_anomaly THEN 'dataset_label' END AS anomaly_label
    FROM ev""",
)
def src7(spark, sf):
    """All readings as a wide CSV, written and read back."""
    events = read_labeled_csv(spark, wide_csv(spark, sf), file="readings.csv")
    metric = lambda f: r6(F.try_element_at("metrics", F.lit(f))).alias(f)
    return events.select(
        "sequence", ntz("timestamp").alias("at"), metric("temperature"), metric("engine_rpm"), metric("packet_loss"),
        F.size("metrics").alias("readings"), "is_anomaly", "anomaly_label",
    )


@query("src8_replay_stream", "SELECT sensor_type, device_id, event_id FROM ev")
def src8(spark, sf):
    return streamed(spark, event_stream(spark, sf).select("sensor_type", "device_id", "event_id"), "replay")


@query(
    "src9_inject_anomalies",
    """SELECT event_id, label IS NOT NULL AS is_anomaly, label AS anomaly_label,
      round(CASE label WHEN 'spike:temperature' THEN least(120.0, v1 * 2.5) WHEN 'spike:bytes_in' THEN least(1e9, v1 * 10) ELSE v1 END, 6) AS first_metric,
      round(CASE label WHEN 'flatline:pressure' THEN 4.5 WHEN 'spike:engine_rpm' THEN least(8000.0, v2 * 1.8) ELSE v2 END::DOUBLE, 6) AS second_metric,
      round(CASE WHEN nth IS NOT NULL THEN least(50.0, v3 + nth * 0.05) ELSE v3 END, 6) AS third_metric FROM inj""",
)
def src9(spark, sf):
    injected = inject_anomalies(raw(spark, sf), rate=0.02)
    value = lambda i: r6(F.get(F.map_values("metrics"), F.lit(i)))
    return injected.select(
        "event_id", "is_anomaly", "anomaly_label",
        value(0).alias("first_metric"), value(1).alias("second_metric"), value(2).alias("third_metric"),
    )


# validation ------------------------------------------------------------------

for _key, _cte, _errors in (
    ("v1_schema_errors", "err_schema", va.schema_errors),
    ("v2_unknown_type", "err_type", va.unknown_type_errors),
    ("v3_unknown_field", "err_field", va.unknown_field_errors),
    ("v4_range_errors", "err_range", va.range_errors),
):
    query(_key, f"SELECT event_id, error FROM {_cte}")(
        lambda spark, sf, errors=_errors: raw(spark, sf).select("event_id", F.explode(errors()).alias("error"))
    )


@query(
    "v5_split_valid",
    """SELECT event_id, count(e.error) = 0 AS ok, string_agg(e.error, '; ' ORDER BY e.ord) AS errors
    FROM ev LEFT JOIN errs e USING (event_id) GROUP BY event_id""",
)
def v5(spark, sf):
    good, bad = va.split_valid(va.validate(raw(spark, sf)))
    columns = lambda ok: [
        "event_id", F.lit(ok).alias("ok"),
        F.when(F.size("validation_errors") > 0, F.concat_ws("; ", "validation_errors")).alias("errors"),
    ]
    return good.select(*columns(True)).unionByName(bad.select(*columns(False)))


@query("v6_ingest_latency", "SELECT event_id, round((epoch_us(ingested_at) - epoch_us(ts)) / 1000.0, 6) AS ms FROM ev")
def v6(spark, sf):
    return raw(spark, sf).select("event_id", r6(va.ingest_latency_ms()).alias("ms"))


@query("d1_dedup", "SELECT event_id FROM dd WHERE kept")
def d1(spark, sf):
    return dedup(raw(spark, sf), 5.0).select("event_id")


@query("d1_dedup_stream", "SELECT event_id FROM dd WHERE kept")
def d1_stream(spark, sf):
    df = event_stream(spark, sf).select("event_id", "device_id", "timestamp", "metrics", "ingested_at")
    return streamed(spark, jobs.dedup_stream(df, 5.0).select("event_id"), "dedup")


@query(
    "d2_status",
    "SELECT event_id, CASE WHEN is_invalid THEN 'invalid' WHEN is_deduped THEN 'duplicate' ELSE 'valid' END AS status FROM cls",
)
def d2(spark, sf):
    return classified(spark, sf).select("event_id", "status")


@query(
    "d2_keep_invalid_counts",
    """SELECT count(*) AS ingested, count(*) FILTER (is_invalid) AS invalid, count(*) FILTER (is_dup) AS deduped,
      count(*) FILTER (NOT is_dup) AS valid FROM cls""",
)
def d2_keep(spark, sf):
    df = va.classify(mark_duplicates(va.validate(raw(spark, sf))), drop_invalid=False)
    return df.agg(
        F.count(F.lit(1)).alias("ingested"), F.count_if("is_invalid").alias("invalid"),
        F.count_if("is_deduped").alias("deduped"), F.count_if("is_valid").alias("valid"),
    )


# enrichment ------------------------------------------------------------------


@query(
    "e1_resolve_tenant",
    "SELECT event_id, coalesce(tag_tenant, tenant_id, 'default') AS tenant_id, 'default' AS single_tenant FROM ev",
)
def e1(spark, sf):
    df = raw(spark, sf).withColumn("single_tenant", tenant_of(Tenancy()))
    return resolve_tenant(df, TENANCY).select("event_id", "tenant_id", "single_tenant")


@query(
    "e2_enriched_tags",
    """SELECT v.event_id, t.k AS tag, t.v AS value FROM val v LEFT JOIN (SELECT * FROM (VALUES
        ('industrial', 'Factory machine telemetry'), ('vehicle', 'Fleet vehicle telemetry'),
        ('network', 'Network flow telemetry')) d(sensor_type, description)) d USING (sensor_type),
      LATERAL (SELECT unnest(['source', 'tenant', 'environment', 'sensor_type', 'tenant_id', 'ingest_hour', 'sensor_description']) AS k,
        unnest([source_tag, tag_tenant, 'local', v.sensor_type, v.tenant_id, CAST(hour(ingested_at) AS VARCHAR), description]) AS v) t
    WHERE t.v IS NOT NULL
    UNION ALL SELECT event_id, field || '_unit', c.unit FROM vl JOIN cat c USING (sensor_type, field)
    UNION ALL SELECT event_id, field || '_deviation_sigma', printf('%.2f', abs(value - c.baseline) / greatest(c.noise, 1e-6))
      FROM vl JOIN cat c USING (sensor_type, field)""",
)
def e2(spark, sf):
    df = enrich(flow.check(raw(spark, sf), CFG).filter("is_valid"), tenancy=TENANCY)
    return df.select("event_id", F.explode("enriched_tags").alias("tag", "value"))


@query(
    "e3_deviation",
    """SELECT v.event_id, v.field, c.unit, round(abs(v.value - c.baseline) / greatest(c.noise, 1e-6), 6) AS sigma,
      printf('%.2f', abs(v.value - c.baseline) / greatest(c.noise, 1e-6)) AS sigma_text
    FROM vl v JOIN cat c USING (sensor_type, field)""",
)
def e3(spark, sf):
    df = valid(spark, sf).select("event_id", F.explode(deviations()).alias("field", "d"))
    sigma = F.col("d.sigma")
    return df.select("event_id", "field", F.col("d.unit").alias("unit"), r6(sigma).alias("sigma"), fixed2(sigma).alias("sigma_text"))


@query(
    "e4_metric_vector",
    """SELECT event_id, c.no AS position, round(coalesce(m.value, 0.0), 6) AS value
    FROM ev JOIN cat c USING (sensor_type) LEFT JOIN ml m USING (event_id, field)
    UNION ALL
    SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY field) AS INT), round(value, 6)
    FROM ml WHERE sensor_type NOT IN (SELECT sensor_type FROM types)""",
)
def e4(spark, sf):
    df = raw(spark, sf).select("event_id", F.posexplode(metric_vector()).alias("pos", "v"))
    return df.select("event_id", (F.col("pos") + 1).alias("position"), r6("v").alias("value"))


@query("e5_metrics_long", "SELECT event_id, field, round(value, 6) AS value FROM ml")
def e5(spark, sf):
    return metrics_long(raw(spark, sf)).select("event_id", "field", r6("value").alias("value"))


@query("e6_for_tenant", "SELECT event_id, device_id FROM val WHERE tenant_id = 'acme'")
def e6(spark, sf):
    return for_tenant(valid(spark, sf), "acme").select("event_id", "device_id")


# windows ---------------------------------------------------------------------

STATS = "count, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max, round(std, 6) AS std"


def stats_columns() -> list[Column]:
    return [F.col("count"), *[r6(c).alias(c) for c in ("mean", "min", "max", "std")]]


def frame_columns() -> list[Column]:
    return [ntz("window_start").alias("window_start"), ntz("window_end").alias("window_end")]


@query(
    "w1_anchored_tumbling",
    f"SELECT tenant_id, device_id, sensor_type, window_no, window_start, window_end, field, {STATS} FROM wst WHERE window_no < newest",
)
def w1(spark, sf):
    df = wi.tumbling(stored_valid(spark, sf), CFG.window_size_seconds)
    return df.select(*wi.KEY, "window_no", *frame_columns(), "field", *stats_columns())


@query(
    "w2_running_snapshots",
    f"SELECT tenant_id, device_id, sensor_type, window_no, emitted_at, window_start, window_end, field, {STATS} FROM snap",
)
def w2(spark, sf):
    df = wi.running_snapshots(stored_valid(spark, sf), CFG.window_size_seconds, CFG.slide_interval_seconds)
    return df.select(
        *wi.KEY, "window_no", ntz("emitted_at").alias("emitted_at"), *frame_columns(), "field", *stats_columns()
    )


@query(
    "w3_window_stats",
    f"SELECT tenant_id, device_id, sensor_type, window_start, window_end, field, {STATS} FROM wst",
)
def w3(spark, sf):
    df = wi.tumbling(valid(spark, sf), CFG.window_size_seconds, emit_open=True)
    return df.select(*wi.KEY, *frame_columns(), "field", *stats_columns())


ALIGNED = """SELECT tenant_id, device_id, sensor_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start,
      time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR AS window_end, field, count(*) AS count,
      round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std
    FROM {rows} GROUP BY ALL"""


def aligned_columns(df: DataFrame) -> DataFrame:
    return df.select(*wi.KEY, *frame_columns(), "field", *stats_columns())


@query("w4_aligned_tumbling", ALIGNED.format(rows="vl"))
def w4(spark, sf):
    return aligned_columns(wi.window_stats_aligned(valid(spark, sf), "6 hours"))


@query(
    "w4_aligned_hopping",
    """SELECT tenant_id, device_id, sensor_type, s AS window_start, s + INTERVAL 6 HOUR AS window_end, field, count(*) AS count,
      round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std
    FROM (SELECT *, unnest(range(6)) AS h FROM vl), LATERAL (SELECT date_trunc('hour', ts) - h * INTERVAL 1 HOUR AS s)
    GROUP BY ALL""",
)
def w4_hop(spark, sf):
    return aligned_columns(wi.window_stats_aligned(stored_valid(spark, sf), "6 hours", "1 hour"))


@query(
    "w4_aligned_stream",
    "SELECT * FROM ("
    + ALIGNED.format(
        rows="""(SELECT coalesce(tag_tenant, tenant_id, 'default') AS tenant_id, e.device_id, e.sensor_type, e.ts, m.field, m.value
          FROM ev e JOIN ml m USING (event_id))"""
    )
    + ") WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)",
)
def w4_stream(spark, sf):
    df = resolve_tenant(event_stream(spark, sf), TENANCY)
    out = wi.window_stats_aligned(df, "6 hours", watermark="1 hour")
    return aligned_columns(streamed(spark, out, "aligned"))


@query(
    "w5_late_events",
    """SELECT tenant_id, device_id, sensor_type, count(*) AS events, count(*) FILTER (window_no < open_window) AS late
    FROM late GROUP BY ALL""",
)
def w5(spark, sf):
    placed = wi.arrival_windows(valid(spark, sf), 0.1)
    return placed.groupBy(*wi.KEY).agg(F.count(F.lit(1)).alias("events"), F.count_if("is_late").alias("late"))


@query(
    "w5_completed_windows",
    f"""SELECT tenant_id, device_id, sensor_type, window_no, field, {STATS} FROM (
      SELECT l.tenant_id, l.device_id, l.sensor_type, l.window_no, m.field, count(*) AS count, avg(m.value) AS mean,
        min(m.value) AS min, max(m.value) AS max, stddev_pop(m.value) AS std
      FROM late l JOIN (SELECT tenant_id, device_id, sensor_type, max(open_window) AS newest FROM late GROUP BY ALL) n
        USING (tenant_id, device_id, sensor_type) JOIN ml m USING (event_id)
      WHERE l.window_no >= l.open_window AND l.window_no < n.newest GROUP BY ALL)""",
)
def w5_windows(spark, sf):
    df = wi.completed_arrival_windows(wi.arrival_windows(stored_valid(spark, sf), 0.1))
    return df.select(*wi.KEY, "window_no", "field", *stats_columns())


NUDGED = """count(*) AS count, round(avg(m.value) + 1e-10, 6) AS mean, round(min(m.value), 6) AS min, round(max(m.value), 6) AS max,
      round(stddev_pop(m.value) + 1e-10, 6) AS std"""
SNAPSHOTS = f"""SELECT e.tenant_id, e.device_id, e.sensor_type, e.window_no, e.ts AS emitted_at, m.field, {NUDGED},
      e.window_start, any_value(f.window_end) AS window_end
    FROM {{em}} e JOIN {{em}} b ON b.tenant_id = e.tenant_id AND b.device_id = e.device_id AND b.sensor_type = e.sensor_type
      AND b.window_no = e.window_no AND b.rn <= e.rn JOIN ml m ON m.event_id = b.event_id
      JOIN (SELECT event_id, max(ts) OVER (PARTITION BY tenant_id, device_id, sensor_type, window_no ORDER BY rn) AS window_end FROM {{em}}) f
        ON f.event_id = e.event_id
    WHERE e.emits GROUP BY e.tenant_id, e.device_id, e.sensor_type, e.window_no, e.ts, e.event_id, e.window_start, m.field"""


def nudged_columns() -> list[Column]:
    nudge = [r6(F.col(c) + (NUDGE if c in ("mean", "std") else 0.0)).alias(c) for c in ("mean", "min", "max", "std")]
    return [*wi.KEY, "window_no", *frame_columns(), "field", "count", *nudge]


def emitted_windows(spark, sf) -> DataFrame:
    df = resolve_tenant(event_stream(spark, sf), TENANCY)
    return window_stream(df, CFG.window_size_seconds, CFG.slide_interval_seconds, delay="1 hour")


@query(
    "w1_stream",
    f"""SELECT b.tenant_id, b.device_id, b.sensor_type, b.window_no, b.window_start, b.window_end, m.field, {NUDGED}
    FROM sw b JOIN ml m USING (event_id) WHERE b.window_no < b.newest
    GROUP BY b.tenant_id, b.device_id, b.sensor_type, b.window_no, b.window_start, b.window_end, m.field""",
)
def w1_stream(spark, sf):
    return streamed(spark, emitted_windows(spark, sf), "windows").filter("kind = 'window'").select(*nudged_columns())


@query("w2_stream", SNAPSHOTS.format(em="swm"))
def w2_stream(spark, sf):
    out = streamed(spark, emitted_windows(spark, sf), "windows").filter("kind = 'snapshot'")
    return out.select(*nudged_columns(), ntz("emitted_at").alias("emitted_at"))


@query("w5_arrival_snapshots", SNAPSHOTS.format(em="arm"))
def w5_snapshots(spark, sf):
    df = wi.arrival_snapshots(stored_valid(spark, sf), CFG.window_size_seconds, CFG.slide_interval_seconds)
    return df.select(*nudged_columns(), ntz("emitted_at").alias("emitted_at"))


@query(
    "w6_time_bucket",
    """SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS bucket, tenant_id, count(*) AS n,
      round(max(latency), 6) AS worst FROM val GROUP BY ALL""",
)
def w6(spark, sf):
    aggs = [F.count(F.lit(1)).alias("n"), r6(F.max("ingest_latency_ms")).alias("worst")]
    return plain(wi.time_bucket(valid(spark, sf), BUCKET, aggs, ["tenant_id"]))


# detection -------------------------------------------------------------------


@query("a1_ewma", "SELECT event_id, round(statistical, 6) AS statistical FROM stat")
def a1(spark, sf):
    return sc.ewma_score(stored_valid(spark, sf)).select("event_id", r6("statistical").alias("statistical"))


@query(
    "a1_ewma_stream",
    """SELECT event_id, round(max(CASE WHEN rn < 20 THEN 0.0
        ELSE least(1.0, abs(value - m) / sqrt(greatest(s, 1e-9)) / 3.5) END), 6) AS statistical
    FROM ews GROUP BY event_id""",
)
def a1_stream(spark, sf):
    df = resolve_tenant(event_stream(spark, sf), TENANCY).select("event_id", *sc.DEVICE, "timestamp", "metrics")
    out = jobs.ewma_stream(df, ttl_seconds=None).select("event_id", "statistical")
    return streamed(spark, out, "ewma").select("event_id", r6("statistical").alias("statistical"))


@query("a2_half_space_trees", "SELECT event_id, round(isolation_forest, 6) AS isolation_forest FROM iso")
def a2(spark, sf):
    return sc.hst_score(valid(spark, sf), FULL.trees).select("event_id", r6("isolation_forest").alias("isolation_forest"))


@query("a3_autoencoder")
def a3(spark, sf):
    return sc.autoencoder_score(valid(spark, sf)).select("event_id", r6("autoencoder").alias("autoencoder"))


@query("a4_adwin_drift")
def a4(spark, sf):
    return sc.adwin_drift(valid(spark, sf)).select("event_id", "drift_detected")


@query("a5_rule_scores", "SELECT event_id, field, round(score, 6) AS score, round(rule_based, 6) AS rule_based FROM rl JOIN rule USING (event_id)")
def a5(spark, sf):
    df = sc.with_rules(valid(spark, sf))
    df = df.select("event_id", F.explode("rule_scores").alias("field", "score"), "rule_based")
    return df.select("event_id", "field", r6("score").alias("score"), r6("rule_based").alias("rule_based"))


@query("a6_ensemble", "SELECT event_id, device_id, ts AS at, round(score, 6) AS score, is_anomaly, severity, message FROM anom")
def a6(spark, sf):
    return anomalies(spark, sf).select(
        "event_id", "device_id", ntz("timestamp").alias("at"), r6("score").alias("score"), "is_anomaly", "severity", "message"
    )


@query("a6_methods", "SELECT event_id, name, round(score, 6) AS score FROM meth")
def a6_methods(spark, sf):
    df = anomalies(spark, sf).select("event_id", F.explode("methods").alias("name", "score"))
    return df.select("event_id", "name", r6("score").alias("score"))


@query(
    "a7_severity",
    """SELECT event_id, CASE WHEN (drift AND s >= 0.5) OR s >= 0.9 THEN 'critical' WHEN s >= 0.75 THEN 'high'
      WHEN s >= 0.65 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT event_id, least(1.0, v1 / 150) AS s, seq % 4 = 0 AS drift FROM ev)""",
)
def a7(spark, sf):
    score = F.least(F.lit(1.0), sc.primary_metric() / 150)
    drift = F.col("sequence") % 4 == 0
    return raw(spark, sf).select("event_id", sc.severity(score, drift).alias("severity"))


def frozen_models() -> FrozenModels:
    """A narrow linear network for two of the three sensor types: it keeps the mean of the inputs."""
    import numpy as np

    squeeze, spread = np.array([[1.0, -1.0]] * 3) / 3.0, np.array([[1.0] * 3, [-1.0] * 3])
    return FrozenModels({"industrial": [squeeze, spread], "vehicle": [squeeze, spread]})


@query("a8_frozen_models")
def a8(spark, sf):
    df = sc.score_frozen(valid(spark, sf), frozen_models())
    return df.select("event_id", r6("autoencoder").alias("autoencoder"), r6("ae_recon_mse").alias("ae_recon_mse"))


@query("a8_frozen_all", "SELECT event_id, round(least(1.0, mse / 0.15), 6) AS autoencoder, round(mse, 6) AS ae_recon_mse FROM fzm")
def a8_all(spark, sf):
    """All sensor types by the frozen network, which SQL can follow."""
    df = sc.score_frozen(valid(spark, sf), FrozenModels({}, default=frozen_models().by_type["vehicle"]))
    return df.select("event_id", r6("autoencoder").alias("autoencoder"), r6("ae_recon_mse").alias("ae_recon_mse"))


THREE = Detection(
    weights={"statistical": 0.3, "isolation_forest": 0.3, "rule_based": 0.4}, trees=FULL.trees,
    drift=Drift(enabled=False), autoencoder=Autoencoder(enabled=False),
)


@query(
    "a9_detect_three",
    """SELECT event_id, tenant_id, device_id, round(score, 6) AS score, score >= 0.65 OR rule_based >= 1.0 AS is_anomaly,
      CASE WHEN greatest(score, rule_based) >= 0.9 THEN 'critical' WHEN greatest(score, rule_based) >= 0.75 THEN 'high'
        WHEN greatest(score, rule_based) >= 0.65 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT v.event_id, v.tenant_id, v.device_id, r.rule_based, least(1.0, greatest(0.0, 0.3 * s.statistical + 0.3 * i.isolation_forest + 0.4 * r.rule_based)) AS score
      FROM val v JOIN stat s USING (event_id) JOIN iso i USING (event_id) JOIN rule r USING (event_id))
    WHERE score >= 0.65 OR rule_based >= 0.6""",
)
def a9_three(spark, sf):
    """Detection as a whole, by the three methods that SQL can follow."""
    found = sc.detect(stored_valid(spark, sf), THREE)
    return found.select("event_id", "tenant_id", "device_id", r6("score").alias("score"), "is_anomaly", "severity")


@query("a9_detect")
def a9(spark, sf):
    return plain(sc.detect(valid(spark, sf), FULL).drop("methods"))


# alerts ----------------------------------------------------------------------


@query("al1_candidates", "SELECT event_id, severity FROM cand")
def al1(spark, sf):
    return al.alert_candidates(anomalies(spark, sf), "medium").select("event_id", "severity")


COOLDOWN = Alerting(cooldown_seconds=12 * 3600)


@query("al2_cooldown", "SELECT event_id FROM cool WHERE kept")
def al2(spark, sf):
    return al.cooldown(al.alert_candidates(anomalies(spark, sf)), COOLDOWN.cooldown_seconds).select("event_id")


@query("al2_cooldown_stream", "SELECT event_id FROM cool WHERE kept")
def al2_stream(spark, sf):
    """Anomalies stored by a batch job, those of a device in one file, followed as a stream of as many files a micro-batch as there are cores."""
    out = scratch(spark, "anomalies")
    anomalies(spark, sf).repartition(*sc.DEVICE).write.parquet(out)
    found = replay_stream(spark, out, files_per_trigger=spark.sparkContext.defaultParallelism)
    return streamed(spark, jobs.cooldown_stream(found, COOLDOWN, None).select("event_id"), "cooldown")


# fixed values: the colours of severities
@query(
    "al3_payload",
    """SELECT event_id, CAST(to_json({'attachments': [{'color': CASE severity WHEN 'low' THEN '#36a64f' WHEN 'medium' THEN '#daa038'
        WHEN 'high' THEN '#e01e5a' ELSE '#8b0000' END, 'title': 'Telemetry Anomaly — ' || device_id,
      'text': CASE WHEN message = '' THEN 'Anomaly detected' ELSE message END,
      'fields': [{'title': 'Device', 'value': device_id, 'short': true}, {'title': 'Sensor Type', 'value': sensor_type, 'short': true},
        {'title': 'Score', 'value': printf('%.2f', score), 'short': true}, {'title': 'Severity', 'value': upper(severity), 'short': true},
        {'title': 'Top Signal', 'value': top, 'short': true}],
      'footer': 'tidemark', 'ts': CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)}]}) AS VARCHAR) AS payload
    FROM anom JOIN (SELECT event_id, arg_max(name || '=' || printf('%.2f', score), score * 100 - ord) AS top
      FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, ord) AS k FROM meth) WHERE k = 1 GROUP BY 1)
    USING (event_id)""",
)
def al3(spark, sf):
    return al.alert_payload(anomalies(spark, sf)).select("event_id", "payload")


# sinks -----------------------------------------------------------------------


@query("sk1_idempotent_events", "SELECT tenant_id, device_id, count(*) AS n, count(DISTINCT event_id) AS ids FROM val GROUP BY ALL")
def sk1(spark, sf):
    """The same events written twice are stored once."""
    out = scratch(spark, "events")
    events = valid(spark, sf).select("event_id", *wi.KEY, "timestamp", "metrics")
    tables.write_events(events, out)
    tables.write_events(events, out)
    stored = tables.read_table(spark, out)
    return stored.groupBy("tenant_id", "device_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids")
    )


@query(
    "sk2_stats_and_anomalies",
    """SELECT 'stats' AS kind, tenant_id, count(*) AS n FROM wst WHERE window_no < newest GROUP BY ALL
    UNION ALL SELECT 'anomalies', tenant_id, count(*) FROM anom GROUP BY ALL""",
)
def sk2(spark, sf):
    out, events = scratch(spark, "results"), stored_valid(spark, sf)
    tables.write_stats(wi.tumbling(events, CFG.window_size_seconds), f"{out}/stats")
    tables.write_anomalies(anomalies_of(events), f"{out}/anomalies")
    count = lambda kind: (
        tables.read_table(spark, f"{out}/{kind}").groupBy(F.lit(kind).alias("kind"), "tenant_id").agg(F.count(F.lit(1)).alias("n"))
    )
    return count("stats").unionByName(count("anomalies"))


def four_batches(spark, df: DataFrame, path: str) -> DataFrame:
    """Rows written to files and followed as a stream of four micro-batches, each of as many files as there are cores."""
    files = spark.sparkContext.defaultParallelism
    df.repartition(4 * files).write.parquet(path)
    return replay_stream(spark, path, df.schema, files_per_trigger=files)


@query("sk3_micro_batches", "SELECT sensor_type, count(*) AS n FROM ev GROUP BY 1")
def sk3(spark, sf):
    """Four micro-batches through foreachBatch into the idempotent events table."""
    source, out = scratch(spark, "batches"), scratch(spark, "stored")
    events = resolve_tenant(raw(spark, sf), TENANCY).select("event_id", *wi.KEY, "timestamp", "metrics")
    jobs.start_fan_out(four_batches(spark, events, source), out, f"{out}/state").awaitTermination()
    return jobs.flow_tables(spark, out)["events"].read().groupBy("sensor_type").agg(F.count(F.lit(1)).alias("n"))


FLOW_CFG = Settings(
    tenancy=TENANCY, window_size_seconds=CFG.window_size_seconds, slide_interval_seconds=CFG.slide_interval_seconds,
    detection=Detection(weights=CHECKED.weights, drift=Drift(enabled=False), autoencoder=Autoencoder(enabled=False)),
    alerting=Alerting(cooldown_seconds=12 * 3600),
)


@query(
    "sk2_fan_out",
    """SELECT 'events' AS kind, tenant_id, device_id, event_id AS name, 0.0::DOUBLE AS value FROM val
    UNION ALL SELECT 'anomalies', tenant_id, device_id, event_id, round(score, 6) FROM anom
    UNION ALL SELECT 'alerts', tenant_id, device_id, event_id, round(score, 6) FROM cool JOIN (SELECT event_id, score FROM anom) USING (event_id) WHERE kept
    UNION ALL SELECT 'window', tenant_id, device_id, CAST(window_no AS VARCHAR) || ' ' || field, round(avg(value) + 1e-10, 6)
      FROM (SELECT a.*, max(window_no) OVER (PARTITION BY a.tenant_id, a.device_id, a.sensor_type) AS newest, m.field, m.value FROM arr a JOIN ml m USING (event_id))
      WHERE w = window_no AND window_no < newest GROUP BY tenant_id, device_id, sensor_type, window_no, field""",
)
def sk2_fan_out(spark, sf):
    """The whole stream into its tables, then once more from the start, as after a failure: micro-batches that count already change nothing."""
    out = scratch(spark, "flow")
    for attempt in ("first", "again"):
        for q in jobs.start_flow(event_stream(spark, sf), out, f"{out}/{attempt}", cfg=FLOW_CFG, stream="flow").values():
            q.awaitTermination()
    found = {name: table.read() for name, table in jobs.flow_tables(spark, out).items()}
    shape = lambda df, kind, name, value: df.select(
        F.lit(kind).alias("kind"), "tenant_id", "device_id", name.alias("name"), r6(value).alias("value")
    )
    windows = found["window_stats"].filter("kind = 'window'")
    parts = [shape(found["events"], "events", F.col("event_id"), F.lit(0.0))]
    parts += [shape(found[k], k, F.col("event_id"), F.col("score")) for k in ("anomalies", "alerts")]
    parts.append(shape(windows, "window", F.concat_ws(" ", F.col("window_no").cast("string"), "field"), F.col("mean") + NUDGE))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "sk4_kafka_rows",
    f"SELECT {TOPIC_SQL} AS topic, device_id AS key, round(v1, 6) AS first_metric, seq AS sequence FROM ev",
)
def sk4(spark, sf):
    rows = kafka_rows(resolve_tenant(raw(spark, sf), TENANCY), TOPICS, TENANCY)
    back, _ = parse_events(rows)
    return back.select("topic", "key", r6(sc.primary_metric()).alias("first_metric"), "sequence")


@query("sk5_retention", f"SELECT event_id FROM val WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def sk5(spark, sf):
    return tables.retained(valid(spark, sf), 7, as_of()).select("event_id")


@query(
    "sk6_compaction",
    f"""SELECT event_id, tenant_id, device_id, ts AS at, f1 AS field, round(v1, 6) AS value, CAST(ts AS DATE) < CAST(TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS DATE) AS packed
    FROM val""",
)
def sk6(spark, sf):
    """Old days of a table rewritten in place, twice: all rows are there once, the old ones in the compacted batch."""
    table = BatchTable(spark, scratch(spark, "compacted"), key=("event_id", "timestamp"))
    events = valid(spark, sf).select("event_id", *wi.KEY, "timestamp", "metrics")
    table.write("1", events)
    for _ in range(2):
        table.compact("packed-1", 7, AS_OF)
    first = F.map_entries("metrics")[0]
    rows = table.read().withColumn("packed", F.contains(F.input_file_name(), F.lit("/batch=packed-1/")))
    return rows.select("event_id", "tenant_id", "device_id", ntz("timestamp").alias("at"), first["key"].alias("field"), r6(first["value"]).alias("value"), "packed")


@query("sk7_count_only", "SELECT count(*) AS events FROM ev WHERE src_id % 53 <> 0 AND src_id % 59 <> 0 AND src_id % 61 <> 0")
def sk7(spark, sf):
    events, _ = parse_events(wire(raw(spark, sf)))
    return tables.event_count(events)


# serving ---------------------------------------------------------------------


@query("q1_recent_events", "SELECT event_id, device_id, ts AS at FROM val WHERE tenant_id = 'acme' ORDER BY ts DESC, event_id LIMIT 100")
def q1(spark, sf):
    return se.recent_events(valid(spark, sf), 100, "acme").select("event_id", "device_id", ntz("timestamp").alias("at"))


@query("q1_last_arrivals", "SELECT event_id, device_id FROM val ORDER BY ingested_at DESC, event_id DESC LIMIT 100")
def q1_arrivals(spark, sf):
    return se.last_arrivals(valid(spark, sf), 100).select("event_id", "device_id")


@query("q1_newest_dates", "SELECT event_id, device_id, ts AS at FROM val WHERE tenant_id = 'acme' ORDER BY ts DESC, event_id LIMIT 300")
def q1_newest(spark, sf):
    """The newest events of a stored table, whose older dates are not opened."""
    table = BatchTable(spark, scratch(spark, "by-date"), key=("event_id", "timestamp"))
    table.write("1", valid(spark, sf).select("event_id", *wi.KEY, "timestamp", "metrics"))
    found = se.newest_first(table, se.recent_events, 300, "acme")
    return found.select("event_id", "device_id", ntz("timestamp").alias("at"))


@query("q2_recent_anomalies", "SELECT event_id, device_id, severity, round(score, 6) AS score FROM anom ORDER BY ts DESC, event_id LIMIT 50")
def q2(spark, sf):
    return se.recent_anomalies(anomalies(spark, sf)).select("event_id", "device_id", "severity", r6("score").alias("score"))


@query(
    "q3_recent_window_stats",
    f"""SELECT tenant_id, device_id, sensor_type, window_start, window_end, field, {STATS} FROM wst WHERE window_no < newest
    ORDER BY window_end DESC, tenant_id, device_id, sensor_type, window_start, wst.field LIMIT 100""",
)
def q3(spark, sf):
    stats = wi.tumbling(valid(spark, sf), CFG.window_size_seconds)
    return se.recent_window_stats(stats).select(*wi.KEY, *frame_columns(), "field", *stats_columns())


DEVICES = """SELECT device_id, max(sensor_type) AS sensor_type, max(tenant_id) AS tenant_id, count(*) AS event_count,
      max(ts) AS last_seen, round(arg_max(v1, (ts, event_id)), 6) AS last_first_metric FROM val GROUP BY device_id"""


@query("q4_list_devices", f"{DEVICES} ORDER BY last_seen DESC, device_id LIMIT 200")
def q4(spark, sf):
    return se.list_devices(valid(spark, sf)).select(
        "device_id", "sensor_type", "tenant_id", "event_count", ntz("last_seen").alias("last_seen"),
        r6(F.get(F.map_values("last_metrics"), F.lit(0))).alias("last_first_metric"),
    )


@query(
    "q5_dashboard_snapshot",
    """SELECT 1 AS tenants, (SELECT list(event_id ORDER BY ts DESC, event_id)[1] FROM val WHERE tenant_id = 'acme') AS newest_event,
      (SELECT least(200, count(*)) FROM val WHERE tenant_id = 'acme') AS events,
      (SELECT least(50, count(*)) FROM anom WHERE tenant_id = 'acme') AS anomalies,
      (SELECT valid FROM tm WHERE tenant_id = 'acme') AS valid_events""",
)
def q5(spark, sf):
    checked, found = checked_and_found(spark, sf)
    found = stored(spark, found, "found")
    metrics = me.tenant_metrics(checked, found, throughput_seconds=6 * 3600)
    snap = se.dashboard_snapshot(metrics, checked.filter("is_valid"), found, "acme")
    return snap.select(
        F.size("metrics").alias("tenants"), F.col("events")[0]["event_id"].alias("newest_event"),
        big(F.size("events")).alias("events"), big(F.size("anomalies")).alias("anomalies"),
        F.col("metrics")[0]["events_valid"].alias("valid_events"),
    )


@query(
    "q5_live_snapshot",
    """SELECT 'events' AS kind, tenant_id, event_id, rn AS place, round(v1, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id DESC) AS rn FROM val) WHERE rn <= 200
    UNION ALL SELECT 'anomalies', tenant_id, event_id, rn, round(score, 6) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id DESC) AS rn FROM anom) WHERE rn <= 50""",
)
def q5_live(spark, sf):
    """The dashboard's tables as a stream in four micro-batches of events leaves them."""
    from pyspark.sql import Window as W

    out = scratch(spark, "live")
    checked, found = checked_and_found(spark, sf)
    sources = {"events": checked.filter("is_valid").select("event_id", *wi.KEY, "timestamp", "metrics"), "anomalies": found.drop("methods")}
    latest, tables_ = jobs.snapshot_tables(spark, out), jobs.flow_tables(spark, out)
    for name, df in sources.items():
        stream = four_batches(spark, df, f"{out}/in-{name}")
        jobs.start_table(stream, tables_[name], f"{out}/state-{name}", latest=latest[name]).awaitTermination()
    place = F.row_number().over(W.partitionBy("tenant_id").orderBy(F.desc("timestamp"), F.desc("event_id")))
    shape = lambda name, value: latest[name].read().select(F.lit(name).alias("kind"), "tenant_id", "event_id", big(place).alias("place"), r6(value).alias("value"))
    return shape("events", sc.primary_metric()).unionByName(shape("anomalies", F.col("score")))


@query("q6_distinct_values", "SELECT DISTINCT device_id AS value, 'device' AS kind FROM val UNION ALL SELECT DISTINCT tenant_id, 'tenant' FROM val UNION ALL SELECT DISTINCT sensor_type, 'type' FROM val")
def q6(spark, sf):
    df = valid(spark, sf)
    pick = lambda values, kind: values.toDF("value").select("value", F.lit(kind).alias("kind"))
    return (
        pick(se.distinct_values(df, "device_id"), "device")
        .unionByName(pick(se.tenant_list(df), "tenant"))
        .unionByName(pick(se.distinct_values(df, "sensor_type"), "type"))
    )


@query(
    "q7_device_health",
    """SELECT device_id, last_seen, CASE WHEN TIMESTAMP '2024-01-30 23:57:00' - last_seen < INTERVAL 60 SECOND THEN 'online'
      WHEN TIMESTAMP '2024-01-30 23:57:00' - last_seen < INTERVAL 300 SECOND THEN 'stale' ELSE 'offline' END AS health
    FROM (SELECT device_id, max(ts) AS last_seen FROM val GROUP BY 1)""",
)
def q7(spark, sf):
    devices = se.device_health(se.device_summary(valid(spark, sf)), F.lit("2024-01-30 23:57:00").cast("timestamp"))
    return devices.select("device_id", ntz("last_seen").alias("last_seen"), "health")


@query(
    "q8_search_devices",
    f"SELECT device_id, sensor_type, event_count FROM ({DEVICES}) WHERE (contains(lower(device_id), 'device-00') OR contains(lower(sensor_type), 'device-00')) AND sensor_type = 'vehicle'",
)
def q8(spark, sf):
    found = se.search_devices(se.device_summary(valid(spark, sf)), "DEVICE-00", "vehicle")
    return found.select("device_id", "sensor_type", "event_count")


@query("q9_severity_counts", "SELECT severity, count(*) AS count FROM anom GROUP BY 1")
def q9(spark, sf):
    return se.severity_counts(anomalies(spark, sf))


@query("q10_method_breakdown", "SELECT event_id, name, round(score, 6) AS score FROM meth WHERE name IN ('statistical', 'rule_based')")
def q10(spark, sf):
    return se.method_breakdown(anomalies(spark, sf)).select("event_id", "name", r6("score").alias("score"))


@query("q10_method_breakdown_literal", "SELECT event_id, name, round(score, 6) AS score FROM meth WHERE name = 'statistical'")
def q10_literal(spark, sf):
    df = se.method_breakdown(anomalies(spark, sf), literal_prefixes=True)
    return df.select("event_id", "name", r6("score").alias("score"))


@query(
    "q11_metric_series",
    """SELECT ts AS at, event_id, CASE WHEN f1 = 'temperature' THEN round(v1, 6) END AS temperature,
      CASE WHEN f2 = 'pressure' THEN round(v2::DOUBLE, 6) END AS pressure, CASE WHEN f3 = 'vibration' THEN round(v3, 6) END AS vibration FROM val""",
)
def q11(spark, sf):
    fields = ["temperature", "pressure", "vibration"]
    df = se.metric_series(valid(spark, sf), fields)
    return df.select(ntz("timestamp").alias("at"), "event_id", *[r6(f).alias(f) for f in fields])


HOURLY = """SELECT hour, sum(n) OVER (ORDER BY hour) AS ingested, sum(ok) OVER (ORDER BY hour) AS valid FROM (
      SELECT date_trunc('hour', ingested_at) AS hour, count(*) AS n, count(*) FILTER (is_valid) AS ok FROM cls GROUP BY 1)"""


def hourly_history(spark, sf) -> DataFrame:
    """Counter readings at the end of each hour (one row per hour of the data)."""
    from pyspark.sql import Window as W

    per_hour = classified(spark, sf).groupBy(F.date_trunc("hour", "ingested_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("ok")
    )
    so_far = W.orderBy("hour").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_hour.select("hour", F.sum("n").over(so_far).alias("ingested"), F.sum("ok").over(so_far).alias("valid"))


@query(
    "q12_sparkline",
    f"""SELECT string_agg(CAST(ingested AS VARCHAR), ',' ORDER BY hour) AS ingested, string_agg(CAST(valid AS VARCHAR), ',' ORDER BY hour) AS valid
    FROM (SELECT * FROM ({HOURLY}) ORDER BY hour DESC LIMIT 24)""",
)
def q12(spark, sf):
    line = se.sparkline(hourly_history(spark, sf), ["ingested", "valid"], 24, time="hour")
    return line.select(*[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("ingested", "valid")])


# dashboards ------------------------------------------------------------------

PAST = f"ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}'"
AT = "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS bucket"


@query("b1_event_count", f"SELECT count(*) AS events FROM val WHERE {PAST} AND regexp_matches(tenant_id, '^(acme|globex)$')")
def b1(spark, sf):
    return da.event_count(valid(spark, sf), as_of(), "24 hours", "^(acme|globex)$")


@query("b2_active_devices", f"SELECT count(DISTINCT device_id) AS devices FROM val WHERE {PAST}")
def b2(spark, sf):
    return da.active_devices(valid(spark, sf), as_of(), "24 hours")


@query("b3_anomaly_count", f"SELECT count(*) AS anomalies FROM anom WHERE is_anomaly AND {PAST}")
def b3(spark, sf):
    return da.anomaly_count(anomalies(spark, sf), as_of(), "24 hours")


@query("b4_avg_ingest_latency", f"SELECT round(avg(latency), 2) AS latency FROM val WHERE {PAST}")
def b4(spark, sf):
    return da.avg_ingest_latency(valid(spark, sf), as_of(), "24 hours")


@query("b5_event_rate", f"SELECT {AT}, count(*) AS events, round(count(*) / 21600.0, 6) AS events_per_second FROM val GROUP BY 1")
def b5(spark, sf):
    df = plain(da.event_rate(valid(spark, sf), BUCKET))
    return df.withColumn("events_per_second", r6("events_per_second"))


@query(
    "b6_events_by_type",
    f"SELECT {AT}, sensor_type, count(*) AS events FROM val WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '{AS_OF}' GROUP BY 1, 2",
)
def b6(spark, sf):
    return plain(da.events_by_type(valid(spark, sf), BUCKET, (F.lit("2024-01-10").cast("timestamp"), as_of())))


@query("b7_metric_avg", f"SELECT {AT}, round(avg(v1) + 1e-10, 6) AS temperature FROM val WHERE sensor_type = 'industrial' AND f1 = 'temperature' GROUP BY 1")
def b7(spark, sf):
    df = plain(da.metric_avg(valid(spark, sf), "temperature", "industrial", BUCKET))
    return df.withColumn("temperature", r6(F.col("temperature") + NUDGE))


@query(
    "b8_latency_quantiles",
    f"SELECT {AT}, round(avg(latency), 6) AS avg, round(quantile_cont(latency, 0.95), 6) AS p95 FROM val GROUP BY 1",
)
def b8(spark, sf):
    df = plain(da.latency_quantiles(valid(spark, sf), BUCKET))
    return df.select("bucket", r6("avg").alias("avg"), r6("p95").alias("p95"))


@query(
    "b8_latency_sketch",
    """SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS bucket, count(*) AS samples, round(avg(latency), 4) AS mean, true AS near FROM val GROUP BY 1""",
)
def b8_sketch(spark, sf):
    """A table of sketches, filled by three batches of events, against the exact quantiles: none is off by more than 0.28 percent of the values next to it."""
    events = stored(spark, valid(spark, sf).select("event_id", "timestamp", "ingest_latency_ms"), "latencies")
    out = scratch(spark, "sketches")
    for part in range(3):
        batch = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part)
        da.latency_sketch(batch, BUCKET).write.mode("append").parquet(out)
    found = plain(da.sketched_quantiles(spark.read.parquet(out), (0.95,)))
    start = F.window("timestamp", BUCKET)["start"].alias("bucket")
    values = F.array_sort(F.collect_list("ingest_latency_ms"))
    exact = plain(events.groupBy(start).agg(values.alias("v"))).withColumn("x", F.get("v", F.floor((F.size("v") - 1) * 0.95).cast("int")))
    both = found.join(exact.select("bucket", "x"), "bucket")
    return both.select("bucket", "samples", F.round("mean", 4).alias("mean"), (F.abs(F.col("p95") - F.col("x")) <= F.col("x") * 0.0028).alias("near"))


@query("b9_anomaly_rate", f"SELECT {AT}, count(*) FILTER (is_anomaly) AS anomalies, round(avg(score), 6) AS avg_score FROM anom GROUP BY 1")
def b9(spark, sf):
    return plain(da.anomaly_rate(anomalies(spark, sf), BUCKET)).withColumn("avg_score", r6("avg_score"))


@query("b10_severity_over_time", f"SELECT {AT}, severity, count(*) AS count FROM anom WHERE is_anomaly GROUP BY 1, 2")
def b10(spark, sf):
    return plain(da.severity_over_time(anomalies(spark, sf), BUCKET))


@query(
    "b11_window_mean_avg",
    f"""SELECT {AT.replace("ts,", "window_start,")}, round(avg(mean) + 1e-10, 6) AS vibration FROM wst
    WHERE window_no < newest AND field = 'vibration' GROUP BY 1""",
)
def b11(spark, sf):
    stats = wi.tumbling(valid(spark, sf), CFG.window_size_seconds)
    return plain(da.window_mean_avg(stats, "vibration", BUCKET)).withColumn("vibration", r6(F.col("vibration") + NUDGE))


@query(
    "b12_anomaly_table",
    """SELECT ts AS timestamp, device_id, sensor_type, round(score, 3) AS score, severity, false AS drift_detected, message
    FROM anom WHERE is_anomaly ORDER BY ts DESC, event_id LIMIT 50""",
)
def b12(spark, sf):
    return plain(da.anomaly_table(anomalies(spark, sf)))


@query(
    "b13_tenant_rate",
    """SELECT tenant_id, s + INTERVAL 6 HOUR AS at, round(count(*) / 21600.0, 9) AS rate
    FROM (SELECT *, unnest(range(6)) AS h FROM cls), LATERAL (SELECT date_trunc('hour', ingested_at) - h * INTERVAL 1 HOUR AS s)
    GROUP BY ALL""",
)
def b13(spark, sf):
    df = plain(da.tenant_rate(classified(spark, sf), 6 * 3600, "1 hour", time="ingested_at"))
    return df.withColumn("rate", half_up(F.col("rate"), 9))


COUNTERS = "ingested AS events_ingested, valid AS events_valid, invalid AS events_invalid, deduped AS events_deduped, anomalies_detected"


@query("b14_tenant_totals", f"SELECT tenant_id, {COUNTERS} FROM tm")
def b14(spark, sf):
    return da.tenant_totals(*checked_and_found(spark, sf))


@query(
    "b15_fleet_latency",
    """SELECT round(sum(eps), 9) AS throughput, round(avg(mean), 6) AS latency_avg, round(avg(p95), 6) AS latency_p95,
      round(avg(p99), 6) AS latency_p99 FROM tm""",
)
def b15(spark, sf):
    per_tenant = me.tenant_metrics(*checked_and_found(spark, sf), throughput_seconds=6 * 3600)
    df = da.fleet_latency(per_tenant)
    return df.select(
        half_up(F.col("throughput"), 9).alias("throughput"), *[r6(c).alias(c) for c in ("latency_avg", "latency_p95", "latency_p99")]
    )


def reports(spark, sf) -> DataFrame:
    return ev.report("events", *labelled_and_found(spark, sf), Evaluation())


QUALITY = "round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall, round(f1, 6) AS f1"


def quality_columns(*more: str) -> list[Column]:
    return [r6(c).alias(c) for c in ("precision", "recall", "f1", *more)]


@query(
    "b16_ml_quality",
    f"SELECT 'events' AS dataset, key AS method, {QUALITY} FROM qual WHERE key IN ('ensemble', 'statistical', 'rule_based', 'isolation_forest', 'autoencoder')",
)
def b16(spark, sf):
    return ev.ml_quality(reports(spark, sf)).select("dataset", "method", *quality_columns())


# metrics ---------------------------------------------------------------------


@query(
    "m1_counters",
    """SELECT sum(ingested)::BIGINT AS events_ingested, sum(valid)::BIGINT AS events_valid, sum(invalid)::BIGINT AS events_invalid,
      sum(deduped)::BIGINT AS events_deduped, sum(anomalies_detected)::BIGINT AS anomalies_detected FROM tm""",
)
def m1(spark, sf):
    return me.event_counters(*checked_and_found(spark, sf))


@query(
    "m1_live_counters",
    """SELECT count(*) AS events_ingested, count(*) FILTER (is_valid) AS events_valid, count(*) FILTER (is_invalid) AS events_invalid,
      count(*) FILTER (is_deduped) AS events_deduped, (SELECT count(*) FROM anom) AS anomalies_detected FROM cls""",
)
def m1_live(spark, sf):
    """What a listener counted while the events and anomalies streams ran, a row for each micro-batch, added up."""
    out, listener = scratch(spark, "counted"), LiveCounters()
    spark.streams.addListener(listener)
    try:
        streams = jobs.start_flow(event_stream(spark, sf), out, f"{out}/state", cfg=FLOW_CFG)
        for q in streams.values():
            q.awaitTermination()
        settle(spark)
    finally:
        spark.streams.removeListener(listener)
    mine = [str(streams[n].id) for n in ("events", "anomalies")]
    rows = listener.table(spark).filter(F.col("query").isin(mine))
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns[2:]])


@query(
    "m2_latency_last",
    """SELECT tenant_id, count(*) AS samples, round(avg(latency), 6) AS mean,
      list_sort(list(latency))[least(CAST(floor(count(*) * 95 / 100.0) AS BIGINT), count(*) - 1) + 1] AS p95 FROM lat500 GROUP BY tenant_id""",
)
def m2_last(spark, sf):
    """The newest 500 samples of each tenant, the form with a bound."""
    out = me.latency_stats(valid(spark, sf), percentiles=(95,), by=["tenant_id"], last=500)
    return out.select("tenant_id", "samples", r6("mean").alias("mean"), "p95")


@query("m2_latency_stats", "SELECT tenant_id, samples, round(mean, 6) AS mean, p50, p95, p99 FROM latp")
def m2(spark, sf):
    df = me.latency_stats(valid(spark, sf), percentiles=(50, 95, 99), by=["tenant_id"])
    return df.withColumn("mean", r6("mean"))


BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


@query(
    "m3_histogram",
    "SELECT '<=' || b AS bucket, (SELECT count(*) FROM val WHERE latency <= b AND (b = 1 OR latency > prev)) AS count FROM "
    "(SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 1000]) AS b, unnest([0, 1, 5, 10, 25, 50, 100, 250, 500]) AS prev) "
    "UNION ALL SELECT '>max', count(*) FROM val WHERE latency > 1000",
)
def m3(spark, sf):
    return me.latency_histogram(valid(spark, sf), BOUNDS)


@query("m4_throughput", "SELECT tenant_id, round(eps, 9) AS events_per_second FROM thr")
def m4(spark, sf):
    df = me.throughput(classified(spark, sf), 6 * 3600, ["tenant_id"])
    return df.withColumn("events_per_second", half_up(F.col("events_per_second"), 9))


@query(
    "m5_tenant_metrics",
    f"""SELECT tenant_id, {COUNTERS}, round(mean, 6) AS avg_ingest_latency_ms, round(p95, 6) AS p95_ingest_latency_ms,
      round(p99, 6) AS p99_ingest_latency_ms, round(eps, 9) AS events_per_second FROM tm""",
)
def m5(spark, sf):
    df = me.tenant_metrics(*checked_and_found(spark, sf), throughput_seconds=6 * 3600)
    latency = [f"{c}_ingest_latency_ms" for c in ("avg", "p95", "p99")]
    return df.withColumns({**{c: r6(c) for c in latency}, "events_per_second": half_up(F.col("events_per_second"), 9)})


@query(
    "m6_cumulative_histogram",
    "SELECT le, (SELECT count(*) FROM val WHERE le = '+Inf' OR latency / 1000.0 <= try_cast(le AS DOUBLE)) AS count, "
    "(SELECT round(sum(latency / 1000.0), 6) FROM val) AS sum "
    "FROM (SELECT unnest(['0.001', '0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1', '+Inf']) AS le)",
)
def m6(spark, sf):
    return me.cumulative_histogram(valid(spark, sf)).select("le", "count", r6("sum").alias("sum"))


@query(
    "m7_counter_delta",
    """SELECT date_trunc('hour', ingested_at) AS hour, count(*) AS ingested_delta, count(*) FILTER (is_valid) AS valid_delta FROM cls GROUP BY 1""",
)
def m7(spark, sf):
    history = hourly_history(spark, sf).withColumn("source", F.lit("all"))
    return plain(me.counter_delta(history, ["ingested", "valid"], ["source"], "hour").drop("source"))


# evaluation ------------------------------------------------------------------


@query("ev1_evaluate", f"SELECT tp, fp, tn, fn, {QUALITY}, round(accuracy, 6) AS accuracy FROM qual WHERE key = 'ensemble'")
def ev1(spark, sf):
    rows = ev.eval_rows(*labelled_and_found(spark, sf), 50)
    return ev.evaluate(rows, 0.65).select("tp", "fp", "tn", "fn", *quality_columns("accuracy"))


@query(
    "ev2_methods",
    f"SELECT key AS method, tp, fp, tn, fn, {QUALITY} FROM qual WHERE key IN ('statistical', 'rule_based', 'isolation_forest', 'autoencoder')",
)
def ev2(spark, sf):
    rows = ev.eval_rows(*labelled_and_found(spark, sf), 50)
    return ev.evaluate_methods(rows, 0.65).select("method", "tp", "fp", "tn", "fn", *quality_columns())


@query(
    "ev3_sweep",
    f"SELECT CAST(key AS DOUBLE) AS threshold, tp, fp, tn, fn, {QUALITY} FROM qual WHERE key LIKE '0.%'",
)
def ev3(spark, sf):
    rows = ev.eval_rows(*labelled_and_found(spark, sf), 50)
    return ev.threshold_sweep(rows).select("threshold", "tp", "fp", "tn", "fn", *quality_columns())


@query(
    "ev4_labeled_csv",
    """SELECT (SELECT count(*) FROM csv) AS total_events, (SELECT count(is_anomaly) FROM csv) AS labeled_events, t AS threshold, tp, fp, tn, fn,
      round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall
    FROM csvc UNION ALL
    SELECT (SELECT count(*) FROM csv), (SELECT count(is_anomaly) FROM csv), -1.0, tp, fp, tn, fn,
      round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6), round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) FROM csvc WHERE t = 0.65""",
)
def ev4(spark, sf):
    """A labelled CSV of all readings as one device's, from the file to the JSON report and back: the sweep, and the ensemble as -1."""
    rules = Detection(weights={"rule_based": 1.0}, drift=Drift(enabled=False), autoencoder=Autoencoder(enabled=False))
    out = scratch(spark, "report")
    write_report(evaluate_csv(spark, wide_csv(spark, sf), dataset="readings.csv", cfg=Settings(detection=rules)), out)
    one = "threshold double, precision double, recall double, tp long, fp long, tn long, fn long"
    fields = one.split(", ")
    nested = "struct<" + ", ".join(f.replace(" ", ": ") for f in fields) + ">"
    shape = f"total_events long, labeled_events long, precision double, recall double, confusion struct<tp: long, fp: long, tn: long, fn: long>, threshold_sweep array<{nested}>"
    r = spark.read.schema("value string").text(out).select(F.from_json("value", shape).alias("r")).select("r.*")
    whole = F.struct(F.lit(-1.0).alias("threshold"), "precision", "recall", *[F.col(f"confusion.{c}").alias(c) for c in ("tp", "fp", "tn", "fn")])
    rows = r.select("total_events", "labeled_events", F.inline(F.concat("threshold_sweep", F.array(whole))))
    return rows.select("total_events", "labeled_events", "threshold", "tp", "fp", "tn", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(
    "ev5_compare_runs",
    f"""SELECT 'rules and average' AS run, 'ensemble' AS method, {QUALITY} FROM qual WHERE key = 'ensemble'
    UNION ALL SELECT 'rules alone', 'ensemble', {QUALITY} FROM qual WHERE key = 'rule_based'""",
)
def ev5(spark, sf):
    rules_only = Detection(weights={"rule_based": 1.0})
    events, found = labelled_and_found(spark, sf)
    rules = sc.ensemble(sc.with_rules(events), rules_only)
    runs = {
        "rules and average": ev.report("events", events, found, Evaluation()),
        "rules alone": ev.report("events", events, rules, Evaluation()),
    }
    both = ev.compare_runs(runs)
    return both.select("run", F.lit("ensemble").alias("method"), *quality_columns())
