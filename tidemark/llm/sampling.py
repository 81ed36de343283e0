"""Bounded samples that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_hash(df: DataFrame, by: str, most: int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """(rows with the `most` smallest hashes of `key` for each value of `by`, with their `rank`; rows of each value).

    A first aggregation counts the values of `by` (few: labels or languages). A threshold on the hash then leaves
    about twice `most` rows of each value before they are ranked, however large the table is.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    if not counts:
        return df.limit(0).withColumn("rank", F.lit(0)), counts
    u = F.xxhash64(F.col(key)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * most + 50) / n))])
    some = df.where(u < F.element_at(share, F.col(by)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(u, key))
    return some.withColumn("rank", rank).where(F.col("rank") <= most), counts
