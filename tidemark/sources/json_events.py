"""JSON payloads to typed sensor events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.expr import parse_ts
from tidemark.schema import SENSOR_EVENT, WIRE_EVENT

_BROKEN = "_broken"


def _number(text: Column) -> Column:
    """Numbers may be quoted; true and false count as 1 and 0."""
    word = F.lower(F.trim(text))
    return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(F.trim(text).try_cast("double"))


def _flag(text: Column) -> Column:
    word = F.lower(F.trim(text))
    # fixed values: words read as booleans
    return F.when(word.isin("true", "1", "1.0", "yes", "y", "on", "t"), True).when(
        word.isin("false", "0", "0.0", "no", "n", "off", "f"), False
    )


def _typed(df: DataFrame, value: str) -> DataFrame:
    schema = StructType([*WIRE_EVENT.fields, StructField(_BROKEN, StringType())])
    wire = F.from_json(F.col(value).cast("string"), schema, {"columnNameOfCorruptRecord": _BROKEN})
    # a generator parses once per row: a filter on the result is not pushed
    # below it, which would repeat the parsing for each use of a field
    df = df.select("*", F.explode(F.array(wire)).alias("_w"))
    w = lambda name: F.col("_w")[name]
    sequence = _number(w("sequence"))
    bad_value = F.exists(F.map_values(w("metrics")), lambda v: _number(v).isNull())
    reason = (
        F.when(F.col("_w").isNull() | w(_BROKEN).isNotNull(), "not a JSON object of the expected shape")
        .when(w("device_id").isNull(), "device_id missing")
        .when(w("sensor_type").isNull(), "sensor_type missing")
        .when(parse_ts(w("timestamp")).isNull(), "timestamp missing or unreadable")
        .when(w("metrics").isNull(), "metrics missing")
        .when(F.coalesce(bad_value, F.lit(False)), "metric is not a number")
        .when(F.exists(F.map_values(w("tags")), lambda v: v.isNull()), "tag is not a string")
        .when(w("sequence").isNotNull() & (sequence.isNull() | (sequence != F.floor(sequence))), "sequence is not an integer")
        .when(w("is_anomaly").isNotNull() & _flag(w("is_anomaly")).isNull(), "is_anomaly is not a boolean")
    )
    event = F.struct(
        w("device_id").alias("device_id"),
        w("sensor_type").alias("sensor_type"),
        parse_ts(w("timestamp")).alias("timestamp"),
        F.transform_values(w("metrics"), lambda _, v: _number(v)).alias("metrics"),
        sequence.cast("bigint").alias("sequence"),
        F.coalesce(w("tags"), F.create_map().cast("map<string,string>")).alias("tags"),
        w("tenant_id").alias("tenant_id"),
        _flag(w("is_anomaly")).alias("is_anomaly"),
        w("anomaly_label").alias("anomaly_label"),
    )
    return df.select("*", F.explode(F.array(reason)).alias("reject_reason")).withColumn("_event", event).drop("_w")


def parse_events(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, rejects). Unknown keys are ignored; rejects keep the payload and say why."""
    typed = _typed(df, value)
    rest = [c for c in df.columns if c != value]
    good = typed.filter(F.col("reject_reason").isNull())
    events = good.select(*rest, *[F.col("_event")[n].alias(n) for n in SENSOR_EVENT.names])
    rejects = typed.filter(F.col("reject_reason").isNotNull()).select(*rest, value, "reject_reason")
    return events, rejects


def with_event_id(df: DataFrame, source_key: list[str]) -> DataFrame:
    """Stable id from tenant and source position (such as topic, partition, offset), so replays collide."""
    tenant = F.coalesce(F.col("tenant_id"), F.lit(""))
    return df.withColumn("event_id", F.sha2(F.concat_ws("|", tenant, *[F.col(c).cast("string") for c in source_key]), 256))
