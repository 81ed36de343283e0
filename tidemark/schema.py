"""Row layouts shared by batch and streaming jobs."""

from pyspark.sql import types as T

_MAP_D = T.MapType(T.StringType(), T.DoubleType())
_MAP_S = T.MapType(T.StringType(), T.StringType())


def _struct(**cols):
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


# JSON as it arrives. Numbers stay text until cast one by one, so a quoted
# number does not null the whole map.
WIRE_EVENT = _struct(
    device_id=T.StringType(),
    sensor_type=T.StringType(),
    timestamp=T.StringType(),
    metrics=_MAP_S,
    sequence=T.StringType(),
    tags=_MAP_S,
    tenant_id=T.StringType(),
    is_anomaly=T.StringType(),
    anomaly_label=T.StringType(),
)

SENSOR_EVENT = _struct(
    device_id=T.StringType(),
    sensor_type=T.StringType(),
    timestamp=T.TimestampType(),
    metrics=_MAP_D,
    sequence=T.LongType(),
    tags=_MAP_S,
    tenant_id=T.StringType(),
    is_anomaly=T.BooleanType(),
    anomaly_label=T.StringType(),
)

ENRICHED_EVENT = T.StructType(
    SENSOR_EVENT.fields
    + _struct(
        event_id=T.StringType(),
        ingested_at=T.TimestampType(),
        ingest_latency_ms=T.DoubleType(),
        validation_errors=T.ArrayType(T.StringType()),
        enriched_tags=_MAP_S,
    ).fields
)

WINDOW_STATS = _struct(
    tenant_id=T.StringType(),
    device_id=T.StringType(),
    sensor_type=T.StringType(),
    window_start=T.TimestampType(),
    window_end=T.TimestampType(),
    field=T.StringType(),
    count=T.LongType(),
    mean=T.DoubleType(),
    min=T.DoubleType(),
    max=T.DoubleType(),
    std=T.DoubleType(),
)

ANOMALY_SCORE = _struct(
    event_id=T.StringType(),
    tenant_id=T.StringType(),
    device_id=T.StringType(),
    sensor_type=T.StringType(),
    timestamp=T.TimestampType(),
    score=T.DoubleType(),
    is_anomaly=T.BooleanType(),
    severity=T.StringType(),
    methods=_MAP_D,
    drift_detected=T.BooleanType(),
    message=T.StringType(),
)
