"""Duplicate deliveries within a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expr import seconds_to_us
from tidemark.operators.spacing import Spacing
from tidemark.operators.split_scan import BLOCK_SECONDS, block_of, split_scan

DUPLICATE_ERROR = "dedup: duplicate event within window"


def dedup_key() -> Column:
    """128-bit digest of device, event time and the metrics sorted by name.

    Tenant and sensor type are not part of it.
    """
    pairs = F.transform(
        F.sort_array(F.map_entries("metrics")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    text = F.concat_ws(
        "|", F.col("device_id"), F.unix_micros("timestamp").cast("string"), F.concat_ws(",", pairs)
    )
    return F.unhex(F.md5(text))


def duplicate_ids(df: DataFrame, window_seconds: float, *, block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """event_id of every delivery that repeats one kept at most `window_seconds` before.

    Only key, arrival time and id are shuffled, by key and block of time, so a key delivered over and over is spread.
    A delivery that no other of its key is near is kept, and changes nothing for those after it: such rows, nearly all
    of them, drop out in the JVM before the ordered pass. Near the edge of a block a delivery counts as not alone.
    """
    gap, block = seconds_to_us(window_seconds), seconds_to_us(block_seconds)
    narrow = df.select(dedup_key().alias("dedup_key"), "ingested_at", "event_id")
    near = W.partitionBy("dedup_key", "_block").orderBy("ingested_at")
    at = F.unix_micros("ingested_at")
    close = lambda other: F.abs(at - F.unix_micros(other)) <= gap
    edge = F.pmod(at, F.lit(block))
    suspect = close(F.lag("ingested_at").over(near)) | close(F.lead("ingested_at").over(near))
    suspect = F.coalesce(suspect, F.lit(False)) | F.coalesce((edge <= gap) | (edge >= block - gap), F.lit(True))
    suspects = narrow.withColumn("_block", block_of("ingested_at", block_seconds)).withColumn("_near", suspect)
    suspects = suspects.filter("_near").drop("_near", "_block")
    spacing = Spacing("ingested_at", gap, strict=True)
    scanned = split_scan(suspects, ["dedup_key"], ["ingested_at", "event_id"], spacing, block_seconds=block_seconds)
    return scanned.filter(~F.col("kept")).select("event_id")


def mark_duplicates(
    df: DataFrame, window_seconds: float = 5.0, *, deliveries: DataFrame | None = None, **scan
) -> DataFrame:
    """Adds is_duplicate, and the duplicate mark to validation_errors when that column is there.

    event_id names one delivery. The ids of duplicates come back through a
    join on it: unique keys, so no skew, and a broadcast when they are few.
    `deliveries` gives the same rows before costly columns were added, to find
    the duplicates without them.
    """
    ids = duplicate_ids(df if deliveries is None else deliveries, window_seconds, **scan).withColumn("is_duplicate", F.lit(True))
    out = df.join(ids, "event_id", "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    if "validation_errors" in df.columns:
        marked = F.array_append("validation_errors", F.lit(DUPLICATE_ERROR))
        out = out.withColumn(
            "validation_errors", F.when(F.col("is_duplicate"), marked).otherwise(F.col("validation_errors"))
        )
    return out


def dedup(df: DataFrame, window_seconds: float = 5.0, **scan) -> DataFrame:
    """Only the kept deliveries."""
    return df.join(duplicate_ids(df, window_seconds, **scan), "event_id", "left_anti")
