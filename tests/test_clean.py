"""Parsing, validation, enrichment and tenants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import Catalog, KafkaTopics, Settings, Tenancy
from tidemark.functions.expr import fixed2, number_text, parse_ts
from tidemark.operators import validate as va
from tidemark.operators.dedup import DUPLICATE_ERROR, mark_duplicates
from tidemark.operators.enrich import enrich, for_tenant, metric_vector, metrics_long
from tidemark.sources.json_events import parse_events
from tidemark.sources.kafka import consumer_topics, kafka_rows, source_options, stamp_tenant, tenant_from_topic, topic_name
from tests.events import at, by_id, events

GOOD = {"temperature": 65.0, "pressure": 4.5, "vibration": 3.2}


def test_fixed2_is_python_rounding(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 0.615, 2.675, 1.005, 0.0, 0.995, 99.995, 0.004999, 0.005, 0.015, 123456.785, -0.125]
    values += [round(rng.random() * 10 ** rng.randint(0, 6), rng.randint(2, 6)) for _ in range(3000)]
    values += [rng.randint(0, 10**6) / 8 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", fixed2(F.col("v")).alias("t")).collect():
        assert r["t"] == f"{r['v']:.2f}"


def test_number_text(spark):
    values = [1e9, 1.5e7, 12.25, 0.001, 0.0005, 120.0, 1234567890.125, -20.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(number_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_times(spark):
    texts = ["2024-01-01T00:00:05Z", "2024-01-01T00:00:05", "1704067205", "1704067205.5", "2024-01-01T02:00:05+02:00", "soon", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.unix_micros(parse_ts(F.col("t")))).collect()]
    five = 1704067205_000000
    assert got == [five, five, five, five + 500000, five, None, None, None]


def test_parse_events(spark):
    ok = {"device_id": "d1", "sensor_type": "industrial", "timestamp": "2024-01-01T00:00:00Z", "metrics": {"z": 1.5, "a": "2.5", "t": True}, "sequence": "7", "extra": [1]}
    bad = [
        "not json", "[1]", json.dumps({**ok, "device_id": None}), json.dumps({**ok, "metrics": {"z": "high"}}),
        json.dumps({**ok, "timestamp": "later"}), json.dumps({k: v for k, v in ok.items() if k != "metrics"}),
        json.dumps({**ok, "sequence": 1.5}), json.dumps({**ok, "is_anomaly": "maybe"}), json.dumps(ok)[:-5],
        json.dumps({**ok, "metrics": 3}),
    ]
    df = spark.createDataFrame([(json.dumps(ok),)] + [(b,) for b in bad], "value string")
    good, rejects = parse_events(df)
    (row,) = good.withColumns({"keys": F.map_keys("metrics"), "values": F.map_values("metrics")}).collect()
    assert row["keys"] == ["z", "a", "t"] and row["values"] == [1.5, 2.5, 1.0]
    assert row["sequence"] == 7 and row["tags"] == {} and row["is_anomaly"] is None
    assert {r["value"] for r in rejects.collect()} == set(bad)
    assert all(r["reject_reason"] for r in rejects.collect())


def errors_of(spark, **change):
    row = {"seconds": 0, "metrics": GOOD, **change}
    return va.validate(events(spark, [row])).first()["validation_errors"]


def test_validation_errors(spark):
    assert errors_of(spark) == []
    assert errors_of(spark, metrics={"temperature": -20.0, "pressure": 10.0}) == []
    assert errors_of(spark, metrics={"temperature": 120.5}) == ["range: temperature=120.5 outside [-20.0, 120.0]"]
    assert errors_of(spark, metrics={"humidity": 1.0}) == ["unknown metric field: humidity"]
    assert errors_of(spark, metrics={}) == ["schema: {} should be non-empty"]
    assert errors_of(spark, sequence=-1) == ["schema: -1 is less than the minimum of 0"]
    assert errors_of(spark, device_id="a b") == ["schema: 'a b' does not match '^[a-zA-Z0-9_-]+$'"]
    assert len(errors_of(spark, device_id="x" * 129)) == 1 and errors_of(spark, device_id="x" * 128) == []
    assert len(errors_of(spark, tenant_id="t" * 65)) == 1
    assert errors_of(spark, sensor_type="marine") == [
        "schema: 'marine' is not one of ['industrial', 'vehicle', 'network']",
        "unknown sensor_type: marine",
    ]


def test_status_of_duplicates(spark):
    rows = [
        {"seconds": 0, "metrics": GOOD}, {"seconds": 0, "ingested": 3, "metrics": GOOD},
        {"seconds": 0, "ingested": 8, "metrics": GOOD}, {"seconds": 1, "metrics": {"humidity": 1.0}},
        {"seconds": 1, "ingested": 2, "metrics": {"humidity": 1.0}},
    ]
    marked = mark_duplicates(va.validate(events(spark, rows)))
    assert by_id(va.classify(marked), "status") == {
        "e00000": ("valid",), "e00001": ("duplicate",), "e00002": ("valid",), "e00003": ("invalid",), "e00004": ("invalid",),
    }
    assert by_id(marked, "validation_errors")["e00001"] == ([DUPLICATE_ERROR],)
    kept = by_id(va.classify(marked, drop_invalid=False), "is_invalid", "is_deduped", "is_valid")
    assert kept["e00003"] == (True, False, True) and kept["e00004"] == (True, True, False)


def test_enrich(spark):
    rows = [{"seconds": 3 * 3600, "metrics": {**GOOD, "temperature": 65.25}, "tags": {"source": "x", "environment": "mine", "tenant": "acme"}}]
    row = enrich(events(spark, rows), environment="prod", tenancy=Tenancy(enabled=True)).first()
    assert row["tenant_id"] == "acme"
    assert row["tags"] == row["enriched_tags"] == {
        "source": "x", "environment": "prod", "tenant": "acme", "sensor_type": "industrial", "tenant_id": "acme",
        "ingest_hour": "3", "sensor_description": "Factory machine telemetry", "temperature_unit": "celsius",
        "temperature_deviation_sigma": "0.12", "pressure_unit": "bar", "pressure_deviation_sigma": "0.00",
        "vibration_unit": "mm/s", "vibration_deviation_sigma": "0.00",
    }
    assert row["deviation_sigma"]["temperature"] == 0.125


@pytest.mark.parametrize(
    "tags,explicit,want",
    [
        ({"tenant_id": "acme", "tenant": "b"}, "c", "acme"), ({"tenant": "b"}, "c", "b"), ({}, "c", "c"),
        ({"tenant_id": ""}, "", "default"), ({}, None, "default"),
    ],
)
def test_tenants(spark, tags, explicit, want):
    rows = [{"seconds": 0, "metrics": GOOD, "tags": tags, "tenant_id": explicit}]
    assert enrich(events(spark, rows), tenancy=Tenancy(enabled=True)).first()["tenant_id"] == want
    assert enrich(events(spark, rows)).first()["tenant_id"] == "default"


def test_vector_and_long_form(spark):
    df = events(spark, [{"seconds": 0, "metrics": {"vibration": 3.0, "temperature": 1.0}}, {"seconds": 1, "sensor_type": "new", "metrics": {"b": 2.0, "a": 1.0}}])
    assert [r[0] for r in df.orderBy("timestamp").select(metric_vector()).collect()] == [[1.0, 0.0, 3.0], [1.0, 2.0]]
    assert metrics_long(df).count() == 4
    assert for_tenant(df, "default").count() == 2 and for_tenant(df, "x").count() == 0


TOPICS = KafkaTopics(topic_per_tenant=True, tenant_topics={"acme": "acme.special"})


def test_topics(spark):
    on = Tenancy(enabled=True, tenants=("b", "a"))
    assert consumer_topics(TOPICS, on) == ["acme.special", "telemetry.events.a", "telemetry.events.b", "telemetry.events.default"]
    assert consumer_topics(TOPICS, Tenancy()) == ["telemetry.events"]
    assert topic_name("x", KafkaTopics(topic_template="fixed")) == "telemetry.events"
    options = source_options(KafkaTopics(replay_mode=True, max_offsets_per_trigger=5))
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "5"
    assert source_options(KafkaTopics())["startingOffsets"] == "latest"
    df = spark.createDataFrame([("t.a.in",), ("t..in",), ("x.a.in",), ("t.a.out",), ("t.in",)], "topic string")
    got = [r[0] for r in df.select(tenant_from_topic(F.col("topic"), "t.{tenant_id}.in")).collect()]
    assert got == ["a", None, None, None, None]


def test_stamp_and_kafka_rows(spark):
    rows = [{"seconds": i, "metrics": GOOD, "tenant_id": t} for i, t in enumerate([None, "acme", "b"])]
    df = events(spark, rows).withColumn("topic", F.lit("telemetry.events.b"))
    got = by_id(stamp_tenant(df, TOPICS), "tenant_id", "tags", "tenant_mismatch")
    assert got == {"e00000": ("b", {"tenant_id": "b"}, False), "e00001": ("acme", {}, True), "e00002": ("b", {}, False)}
    out = kafka_rows(events(spark, rows), TOPICS, Tenancy(enabled=True)).orderBy("value").collect()
    assert sorted(r["topic"] for r in out) == ["acme.special", "telemetry.events.b", "telemetry.events.default"]
    back, rejects = parse_events(kafka_rows(events(spark, rows), TOPICS))
    assert rejects.count() == 0
    assert {r["timestamp"].replace(tzinfo=None) for r in back.collect()} == {at(i).replace(tzinfo=None) for i in range(3)}


def test_settings_from_files(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"window_size_seconds": 20, "detection": {"ewma": {"alpha": 0.2}}, "tenancy": {"enabled": True}}))
    cfg = Settings.load(str(path))
    assert cfg.window_size_seconds == 20 and cfg.detection.ewma.alpha == 0.2 and cfg.tenancy.enabled
    with pytest.raises(KeyError):
        Settings.from_dict({"no_such_setting": 1})
    raw = {"sensor_types": {"x": {"fields": {"f": {"unit": "u", "min": 0, "max": 1, "baseline": 0, "noise_std": 1}}}}, "rules": {"f": {"warn_above": 1}}}
    assert Catalog.from_dict(raw).rules["f"].warn_above == 1.0
