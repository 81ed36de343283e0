"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed


EDGES = 20_000  # edges a task


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge. edges: a long, b long.

    Every round is two aggregations and joins over the edges; rounds grow with the logarithm of the longest path.
    A vertex with many neighbours is never collected into one row. Tables take as many tasks as their edges fill, so
    that the rounds over a few edges do not leave a file for each pair of tasks.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = checkpointed(both), None
    tasks = now.count() // EDGES + 1
    while True:
        now = now.coalesce(tasks)
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct()
        large = large.coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m").coalesce(tasks)
        stars = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = checkpointed(stars.where("a <> b").distinct().coalesce(tasks))
        sums = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())
        if sums == before:
            break
        before = sums
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    return now.unionByName(roots).select(F.col("a").alias("id"), F.col("b").alias("component"))
