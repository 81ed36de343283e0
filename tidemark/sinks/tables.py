"""Parquet tables by tenant and date: idempotent writes, retention, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["tenant_id", "date"]
SORT = ["sensor_type", "device_id", "timestamp"]


def dated(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.withColumn("date", F.to_date(time))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A stored table, with a time range that also prunes date partitions."""
    df = spark.read.parquet(path)
    return between(df, since, until)


def between(df: DataFrame, since: str | None = None, until: str | None = None, time: str = "timestamp") -> DataFrame:
    if since is not None:
        at = F.lit(since).cast("timestamp")
        df = df.filter((F.col(time) >= at) & (F.col("date") >= F.to_date(at)))
    if until is not None:
        at = F.lit(until).cast("timestamp")
        df = df.filter((F.col(time) < at) & (F.col("date") <= F.to_date(at)))
    return df


def write_append(df: DataFrame, path: str, time: str = "timestamp") -> None:
    """Appends. Rebalancing gathers a partition's rows into few files, and lets
    adaptive execution split a tenant or day that holds most of the rows."""
    out = dated(df, time).hint("rebalance", *PARTITIONS)
    out.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def new_events(df: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows whose (event_id, timestamp) is neither stored nor earlier in the batch."""
    fresh = dated(df).dropDuplicates(["event_id", "timestamp"])
    if stored is None:
        return fresh
    return fresh.join(stored.select("event_id", "timestamp", "date"), ["event_id", "timestamp", "date"], "left_anti")


def write_events(df: DataFrame, path: str) -> None:
    """Adds events that are not there yet; writing a batch twice changes nothing.

    Of the stored table only the folders of the batch's tenants and dates are
    opened, as many as the batch writes. A job that may die halfway writes to
    a `BatchTable` instead.
    """
    spark = df.sparkSession
    stored = None
    if _exists(spark, path):
        pairs = {(r[0], str(r[1])) for r in dated(df).select(*PARTITIONS).distinct().collect()}
        folders = [d for d, tenant, date in _partition_dirs(spark, path) if (tenant, date) in pairs]
        if folders:
            stored = spark.read.option("basePath", path).parquet(*folders)
    write_append(new_events(df, stored).drop("date"), path)


def write_stats(stats: DataFrame, path: str) -> None:
    write_append(stats, path, time="window_start")


def write_anomalies(anomalies: DataFrame, path: str) -> None:
    write_append(anomalies, path)


def retained(df: DataFrame, days: int, as_of: Column, time: str = "timestamp") -> DataFrame:
    """Rows not older than `days` at `as_of`; dates of a stored table that lie wholly before are not read."""
    first = as_of - F.make_dt_interval(days=F.lit(days))
    kept = df.filter(F.col(time) >= first)
    return kept.filter(F.col("date") >= F.to_date(first)) if "date" in df.columns else kept


def _partition_dirs(spark: SparkSession, path: str) -> list[tuple[str, str | None, str]]:
    """(directory, tenant, date) of all partitions, from the file system's listing."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop.Path(f"{path.rstrip('/')}/tenant_id=*/date=*"))
    value = lambda p: names.unescapePathName(p.getName().split("=", 1)[1])
    out = []
    for s in found:
        tenant, date = value(s.getPath().getParent()), value(s.getPath())
        out.append((s.getPath().toString(), None if tenant == names.DEFAULT_PARTITION_NAME() else tenant, date))
    return out


def apply_retention(spark: SparkSession, path: str, days: int, as_of: str) -> list[str]:
    """Removes date partitions that lie wholly before as_of - days; returns their dates."""
    cutoff = spark.range(1).select(F.to_date(F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))).first()[0]
    hadoop = spark._jvm.org.apache.hadoop.fs
    removed = []
    for directory, _, date in _partition_dirs(spark, path):
        if date < str(cutoff):
            p = hadoop.Path(directory)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            removed.append(date)
    return sorted(set(removed))


def compact(spark: SparkSession, path: str, target: str, older_than_days: int, as_of: str) -> None:
    """Rewrites date partitions older than the given age into `target`:
    few zstd files, sorted so that row-group statistics prune by type, device and time.

    Each tenant and date replaces what `target` held of it, so a second run
    changes nothing. Within one table, `BatchTable.compact` rewrites and swaps.
    """
    cutoff = F.to_date(F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(older_than_days)))
    old = spark.read.parquet(path).filter(F.col("date") < cutoff)
    (
        old.repartitionByRange(*PARTITIONS, *SORT)
        .sortWithinPartitions(*PARTITIONS, *SORT)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*PARTITIONS)
        .parquet(target)
    )


def event_count(df: DataFrame) -> DataFrame:
    """One row with the number of events, for loads whose rows nobody keeps."""
    return df.agg(F.count(F.lit(1)).alias("events"))


def count_only(df: DataFrame) -> int:
    """Parses everything and keeps nothing but the count."""
    from pyspark.sql import Observation

    seen = Observation("count_only")
    df.observe(seen, F.count(F.lit(1)).alias("events")).write.format("noop").mode("overwrite").save()
    return seen.get["events"]
