"""Session settings the jobs rely on, and where they may keep intermediate data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the expressions assume. All are run-time settings of a live session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # lets "newest N per group" cut each task's rows before the shuffle
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder.

    A cluster names it in spark.checkpoint.dir. Only a session on one machine
    (unit tests, local runs) gets a temporary folder where none is named.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not configured and not sc.master.split("[")[0] == "local":
            raise RuntimeError("a cluster names a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tidemark-"))
        current = sc.getCheckpointDir()
    return configured or current


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables written by one job run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: partitions and their row order are fixed from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
