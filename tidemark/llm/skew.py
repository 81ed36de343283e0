"""Joining rows with facts about their group where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with groups, which holds one row for each key and the number of its rows in `size`.

    Keys with more than one SHARE-th of the `total` rows, of which there can be SHARE at most whatever the table, are
    broadcast, and their rows are spread by a hash of the whole row over the join of all the others. So no task gets
    more than one SHARE-th of the rows for the sake of a key. Rows without a group get nulls.
    """
    values = [c for c in groups.columns if c not in keys]
    is_hot = F.col(size) * SHARE > F.lit(total)
    hot = groups.where(is_hot).select(*keys, F.struct(*values).alias("_hot"))
    cold = groups.where(~is_hot).select(*keys, F.lit(0).cast("long").alias("_spread"), F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    both = marked.withColumn("_spread", spread).join(cold, [*keys, "_spread"], "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*rows.columns, *[found[v].alias(v) for v in values])
