"""Tenant resolution, tags, deviations from the baseline, metric vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT_CATALOG, Catalog, Tenancy
from tidemark.functions.expr import by_sensor_type, field_defs, fixed2, present

_NO_TEXT = "map<string,string>"


def tag(name: str) -> Column:
    return present(F.try_element_at("tags", F.lit(name)))


def tenant_of(tenancy: Tenancy) -> Column:
    """Tags first, then an explicit tenant other than the default; empty text counts as missing."""
    fallback = F.lit(tenancy.default_tenant)
    if not tenancy.enabled:
        return fallback
    return F.coalesce(tag("tenant_id"), tag("tenant"), present(F.col("tenant_id")), fallback)


def resolve_tenant(df: DataFrame, tenancy: Tenancy = Tenancy()) -> DataFrame:
    return df.withColumn("tenant_id", tenant_of(tenancy))


def deviations(catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """map<field, struct(unit, sigma)> over the metrics the catalog knows."""
    defs = F.try_element_at(field_defs(catalog), F.col("sensor_type"))
    known = F.filter(F.map_entries("metrics"), lambda e: F.try_element_at(defs, e["key"]).isNotNull())

    def describe(e):
        d = F.try_element_at(defs, e["key"])
        sigma = F.abs(e["value"] - d["baseline"]) / F.greatest(d["noise_std"], F.lit(1e-6))
        return F.struct(e["key"].alias("key"), F.struct(d["unit"].alias("unit"), sigma.alias("sigma")).alias("value"))

    return F.map_from_entries(F.transform(known, describe))


def enrich(
    df: DataFrame,
    catalog: Catalog = DEFAULT_CATALOG,
    *,
    environment: str = "local",
    tenancy: Tenancy = Tenancy(),
) -> DataFrame:
    """Resolves the tenant and writes enriched_tags (also into tags); adds deviation_sigma.

    Our tags win over tags of the same name on the event.
    """
    df = resolve_tenant(df, tenancy).withColumn("_dev", deviations(catalog))
    description = by_sensor_type(catalog, lambda t: F.lit(t.description))
    base = F.map_filter(
        F.create_map(
            F.lit("environment"), F.lit(environment),
            F.lit("sensor_type"), F.col("sensor_type"),
            F.lit("tenant_id"), F.col("tenant_id"),
            F.lit("ingest_hour"), F.hour("ingested_at").cast("string"),
            F.lit("sensor_description"), description,
        ),
        lambda k, v: v.isNotNull(),
    )
    per_field = F.flatten(
        F.transform(
            F.map_entries("_dev"),
            lambda e: F.array(
                F.struct(F.concat(e["key"], F.lit("_unit")).alias("key"), e["value"]["unit"].alias("value")),
                F.struct(
                    F.concat(e["key"], F.lit("_deviation_sigma")).alias("key"),
                    fixed2(e["value"]["sigma"]).alias("value"),
                ),
            ),
        )
    )
    own = F.coalesce(F.col("tags"), F.create_map().cast(_NO_TEXT))
    derived = F.coalesce(F.map_from_entries(per_field), F.create_map().cast(_NO_TEXT))
    return (
        df.withColumn("enriched_tags", F.map_concat(own, base, derived))
        .withColumn("tags", F.col("enriched_tags"))
        .withColumn("deviation_sigma", F.transform_values("_dev", lambda _, v: v["sigma"]))
        .drop("_dev")
    )


def metric_vector(catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """array<double> in catalog order, 0.0 where missing; unknown types use their fields sorted by name."""
    vector = by_sensor_type(
        catalog,
        lambda t: F.array(*[F.coalesce(F.try_element_at("metrics", F.lit(f)), F.lit(0.0)) for f in t.fields]),
    )
    by_name = F.transform(F.sort_array(F.map_entries("metrics")), lambda e: e["value"])
    return F.coalesce(vector, by_name)


def metrics_long(df: DataFrame) -> DataFrame:
    """One row per event and field."""
    rest = [c for c in df.columns if c != "metrics"]
    return df.select(*rest, F.explode("metrics").alias("field", "value"))


def for_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    return df if tenant is None else df.filter(F.col("tenant_id") == tenant)
