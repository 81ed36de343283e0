"""Kafka: source options, topic names per tenant, tenants from topic names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import KafkaTopics, Tenancy
from tidemark.functions.expr import literal_map, present
from tidemark.sources.json_events import parse_events, with_event_id

PLACEHOLDER = "{tenant_id}"


def _around(cfg: KafkaTopics) -> tuple[str, str | None]:
    """What stands before and after the tenant in a topic; (topic, None) where all tenants share one."""
    if PLACEHOLDER not in cfg.topic_template:
        return cfg.topic, None
    before, after = cfg.topic_template.split(PLACEHOLDER, 1)
    return before, after


def topic_name(tenant: str, cfg: KafkaTopics) -> str:
    before, after = _around(cfg)
    return cfg.tenant_topics.get(tenant, before if after is None else before + tenant + after)


def consumer_topics(cfg: KafkaTopics, tenancy: Tenancy) -> list[str]:
    """Topics to subscribe to: one, or one per known tenant and override."""
    if not (cfg.topic_per_tenant and tenancy.enabled):
        return [cfg.topic]
    known = {*tenancy.tenants, tenancy.default_tenant, *cfg.tenant_topics}
    return sorted({topic_name(t, cfg) for t in known})


def source_options(cfg: KafkaTopics, tenancy: Tenancy = Tenancy()) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": cfg.bootstrap_servers,
        "subscribe": ",".join(consumer_topics(cfg, tenancy)),
        "startingOffsets": "earliest" if cfg.replay_mode else cfg.auto_offset_reset,
        "failOnDataLoss": "true",
    }
    if cfg.max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(cfg.max_offsets_per_trigger)
    return options


def read_kafka(spark: SparkSession, cfg: KafkaTopics, tenancy: Tenancy = Tenancy()) -> DataFrame:
    """Stream of (topic, partition, offset, value, ingested_at). The checkpoint keeps the offsets."""
    raw = spark.readStream.format("kafka").options(**source_options(cfg, tenancy)).load()
    return raw.select(
        "topic", "partition", "offset", F.col("value").cast("string").alias("value"),
        F.current_timestamp().alias("ingested_at"),
    )


def topic_for_tenant(tenant: Column, cfg: KafkaTopics) -> Column:
    before, after = _around(cfg)
    default = F.lit(before) if after is None else F.concat(F.lit(before), tenant, F.lit(after))
    if not cfg.tenant_topics:
        return default
    override = literal_map({k: F.lit(v) for k, v in cfg.tenant_topics.items()})
    return F.coalesce(F.try_element_at(override, tenant), default)


def tenant_from_topic(topic: Column, template: str) -> Column:
    """What stands in place of {tenant_id}; null when the topic does not fit or nothing is left."""
    if PLACEHOLDER not in template:
        return F.lit(None).cast("string")
    before, after = template.split(PLACEHOLDER, 1)
    middle = F.substring(topic, F.lit(len(before) + 1), F.length(topic) - (len(before) + len(after)))
    fits = topic.startswith(before) & (F.length(topic) > len(before) + len(after))
    if after:
        fits = fits & topic.endswith(after)
    return F.when(fits, middle)


def stamp_tenant(df: DataFrame, cfg: KafkaTopics, topic: str = "topic") -> DataFrame:
    """Fills a missing tenant (and its tag) from the topic; adds tenant_mismatch for a contradiction, which is kept."""
    from_topic = tenant_from_topic(F.col(topic), cfg.topic_template)
    own = present(F.col("tenant_id"))
    stamped = own.isNull() & from_topic.isNotNull()
    tags = F.map_concat("tags", F.create_map(F.lit("tenant_id"), from_topic))
    return df.withColumns(
        {
            "tenant_mismatch": F.coalesce(own != from_topic, F.lit(False)),
            "tags": F.when(stamped, tags).otherwise(F.col("tags")),
            "tenant_id": F.when(stamped, from_topic).otherwise(F.col("tenant_id")),
        }
    )


def topic_events(rows: DataFrame, cfg: KafkaTopics) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of topic rows: parsed, with the topic's tenant, and an id that a replay of the same offset repeats."""
    events, rejects = parse_events(rows)
    return with_event_id(stamp_tenant(events, cfg), ["topic", "partition", "offset"]), rejects


def kafka_rows(df: DataFrame, cfg: KafkaTopics, tenancy: Tenancy = Tenancy()) -> DataFrame:
    """(topic, key, value) rows for a Kafka sink; keyed by device, so a device stays on one partition."""
    per_tenant = cfg.topic_per_tenant and tenancy.enabled
    tenant = F.coalesce(present(F.col("tenant_id")), F.lit(tenancy.default_tenant))
    wire = ["device_id", "sensor_type", "timestamp", "metrics", "sequence", "tags", "tenant_id", "is_anomaly", "anomaly_label"]
    body = [
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp") if c == "timestamp" else F.col(c)
        for c in wire
        if c in df.columns
    ]
    return df.select(
        (topic_for_tenant(tenant, cfg) if per_tenant else F.lit(cfg.topic)).alias("topic"),
        F.col("device_id").alias("key"),
        F.to_json(F.struct(*body)).alias("value"),
    )
