"""Schema and range checks, and the routing of events by their outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT_CATALOG, Catalog
from tidemark.functions.expr import field_defs, number_text, span_us

# Identifier pattern and length limits of the event schema.
ID_PATTERN = "^[a-zA-Z0-9_-]+$"
DEVICE_ID_MAX = 128
TENANT_ID_MAX = 64


def _quoted(col: Column) -> Column:
    return F.concat(F.lit("'"), col, F.lit("'"))


def _identifier(name: str, max_len: int, required: bool) -> list[Column]:
    c = F.col(name)
    checks = [
        F.when(c == "", F.lit("schema: '' should be non-empty")),
        F.when(F.length(c) > max_len, F.concat(F.lit("schema: "), _quoted(c), F.lit(" is too long"))),
        F.when(~c.rlike(ID_PATTERN), F.concat(F.lit("schema: "), _quoted(c), F.lit(f" does not match '{ID_PATTERN}'"))),
    ]
    return ([_missing(name)] if required else []) + checks


def _missing(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit(f"schema: '{name}' is a required property"))


def schema_errors(catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """Errors of the event envelope, by field name."""
    known = list(catalog.sensor_types)
    allowed = "[" + ", ".join(f"'{k}'" for k in known) + "]"
    st, seq = F.col("sensor_type"), F.col("sequence")
    checks = [
        *_identifier("device_id", DEVICE_ID_MAX, required=True),
        _missing("metrics"),
        F.when(F.size("metrics") == 0, F.lit("schema: {} should be non-empty")),
        _missing("sensor_type"),
        F.when(~st.isin(known), F.concat(F.lit("schema: "), _quoted(st), F.lit(f" is not one of {allowed}"))),
        F.when(seq < 0, F.concat(F.lit("schema: "), seq.cast("string"), F.lit(" is less than the minimum of 0"))),
        *_identifier("tenant_id", TENANT_ID_MAX, required=False),
        _missing("timestamp"),
    ]
    return F.array_compact(F.array(*checks))


def unknown_type_errors(catalog: Catalog = DEFAULT_CATALOG) -> Column:
    st = F.col("sensor_type")
    return F.array_compact(
        F.array(F.when(~st.isin(list(catalog.sensor_types)), F.concat(F.lit("unknown sensor_type: "), st)))
    )


def _per_field(catalog: Catalog, unknown: bool, ranges: bool) -> Column:
    defs = F.try_element_at(field_defs(catalog), F.col("sensor_type"))

    def check(entry):
        field, value = entry["key"], entry["value"]
        d = F.try_element_at(defs, field)
        out = F.when(d.isNull(), F.concat(F.lit("unknown metric field: "), field) if unknown else F.lit(None))
        if ranges:
            text = F.concat(
                F.lit("range: "), field, F.lit("="), number_text(value), F.lit(" outside ["),
                number_text(d["min"]), F.lit(", "), number_text(d["max"]), F.lit("]"),
            )
            out = out.when((value < d["min"]) | (value > d["max"]), text)
        return out

    errors = F.array_compact(F.transform(F.map_entries("metrics"), check))
    return F.when(defs.isNotNull() & F.col("metrics").isNotNull(), errors).otherwise(
        F.array().cast("array<string>")
    )


def unknown_field_errors(catalog: Catalog = DEFAULT_CATALOG) -> Column:
    return _per_field(catalog, unknown=True, ranges=False)


def range_errors(catalog: Catalog = DEFAULT_CATALOG) -> Column:
    return _per_field(catalog, unknown=False, ranges=True)


def ingest_latency_ms() -> Column:
    """May be negative: a device clock can run ahead."""
    return span_us(F.col("ingested_at"), F.col("timestamp")) / 1000.0


def validate(df: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Adds validation_errors and ingest_latency_ms."""
    errors = F.concat(
        schema_errors(catalog), unknown_type_errors(catalog), _per_field(catalog, unknown=True, ranges=True)
    )
    # through a generator the errors are worked out once per row; filters on
    # them are not pushed below it with a copy of all the checks
    checked = df.select("*", F.explode(F.array(errors)).alias("validation_errors"))
    return checked.withColumn("ingest_latency_ms", ingest_latency_ms())


def has_errors() -> Column:
    """True when an error other than the duplicate mark is present."""
    return F.exists("validation_errors", lambda e: ~e.startswith("dedup:"))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(~has_errors()), df.filter(has_errors())


def classify(df: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """Adds status (invalid, duplicate or valid) and the flags behind the counters.

    Invalid wins over duplicate. With drop_invalid off an invalid event goes
    on: it counts as invalid and also as duplicate or valid.
    """
    invalid, dup = has_errors(), F.col("is_duplicate")
    stopped = invalid if drop_invalid else F.lit(False)
    return (
        df.withColumn("is_invalid", invalid)
        .withColumn("is_deduped", dup & ~stopped)
        .withColumn("is_valid", ~dup & ~stopped)
        .withColumn(
            "status",
            F.when(F.col("is_valid"), "valid").when(F.col("is_deduped"), "duplicate").otherwise("invalid"),
        )
    )
