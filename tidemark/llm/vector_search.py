"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Vectors are rotated by a random orthogonal matrix, so that any prefix of their
dimensions is a fair sample of a distance. Rows are dealt to the list of their
nearest centroid and stored by columns; a scan of a list adds up squared
differences in blocks of dimensions and after each block gives up candidates
whose partial distance, scaled to all dimensions, is too large at the chosen
significance to be among the nearest found so far. Survivors are measured
exactly on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import columns

STEP, SCAN = 8, 1024  # dimensions between two tests; candidates between two bounds
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 1024
PLACED = "list int, block int, query_block int, vec_id long, vector binary"
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """Rotation, rotated centroids, and into how many blocks the rows and queries of each list are split."""

    rotation: np.ndarray
    centroids: np.ndarray
    blocks: np.ndarray
    query_blocks: np.ndarray
    probes: int


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of rows that take part: no null, zero or non-finite vector."""
    e = F.col("embedding").cast("array<double>")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(ok).select("vec_id", e.alias("embedding"))


def build(vectors: DataFrame, share_of_queries: float, sample: int = 20_000, lists: int | None = None, target: float = 0.97, seed: int = 7) -> Index | None:
    """Centroids by k-means over at most about `sample` rows (those with the smallest hashes of vec_id); None if empty.

    lists defaults to the square root of the number of rows, at most 4096. The number of lists to probe is the smallest
    with which at least `target` of the 10 nearest others within the sample are found, for 256 rows of it. Centroids and
    probes come from the distinct vectors of the sample, so that copies neither repeat a centroid nor fill the lists probed.
    """
    sizes = {r.d: r["count"] for r in vectors.groupBy(F.size("embedding").alias("d")).count().collect()}
    if not sizes:
        return None
    dims = max(sizes, key=lambda d: (sizes[d], -d))
    n = sizes[dims]
    u = F.xxhash64("vec_id").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    rows = vectors.where(F.size("embedding") == dims).where(u < min(1.0, sample / n)).orderBy("vec_id").select("embedding").collect()
    x = np.array([r.embedding for r in rows], float).reshape(len(rows), dims)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x, copy_of = np.unique(x, axis=0, return_inverse=True)
    lists = max(1, min(4096, lists or int(n**0.5), len(x)))
    centroids = x[rng.choice(len(x), lists, replace=False)] if len(x) else np.zeros((1, dims))
    owner = np.zeros(len(x), int)
    for _ in range(12):
        owner = nearest(x, centroids, 1)[:, 0]
        for c in range(len(centroids)):
            if (mine := owner == c).any():
                centroids[c] = x[mine].mean(0)
    owner = nearest(x, centroids, 1)[:, 0]
    if len(x):  # lists without rows go
        used, owner = np.unique(owner, return_inverse=True)
        centroids = centroids[used]
    probes = probes_for(x, owner, centroids, target)
    part = np.bincount(owner[copy_of.ravel()], minlength=len(centroids)) / max(1, len(rows))
    blocks = np.maximum(1, np.ceil(n * part / ROWS_PER_BLOCK)).astype(int)
    asked = n * share_of_queries * np.minimum(1, part * probes)
    return Index(rotation, centroids @ rotation, blocks, np.maximum(1, np.ceil(asked / QUERIES_PER_BLOCK)).astype(int), probes)


def probes_for(x: np.ndarray, owner: np.ndarray, centroids: np.ndarray, target: float, k: int = 10) -> int:
    """Lists to probe, nearest first, so that `target` of the k nearest other rows are in them. x: distinct rows."""
    step = max(1, len(x) // 256)
    some = x[::step]
    if len(x) <= 20 * k:
        return len(centroids)
    place = np.argsort(nearest(some, centroids, len(centroids)), 1)  # of each list among a row's nearest
    found = []
    for i, q in enumerate(some):
        far = ((x - q) ** 2).sum(1)
        far[i * step] = np.inf  # the row itself
        near = np.argpartition(far, k)[:k]
        found.append(place[i, owner[near]])
    found = np.sort(np.concatenate(found))
    return int(found[min(len(found) - 1, int(np.ceil(target * len(found))))]) + 1


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    out, c2 = [np.zeros((0, n), int)], (centroids**2).sum(1)
    for i in range(0, len(x), 2048):
        d = c2 - 2 * x[i : i + 2048] @ centroids.T
        out.append(np.argsort(d, 1, kind="stable")[:, :n] if n > 1 else d.argmin(1)[:, None])
    return np.concatenate(out)


def placed(vectors: DataFrame, index: Index, queries: bool, probes: int | None = None) -> DataFrame:
    """Rows of PLACED: a vector in its list, in one block of rows and every block of queries, or a query the other way round."""
    probes = probes or index.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = len(index.rotation)
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("embedding").to_pylist(), float).reshape(len(ids), dims)
            lists = nearest(x @ index.rotation, index.centroids, probes if queries else 1)
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            rows: dict[str, list] = {f.split()[0]: [] for f in PLACED.split(", ")}
            for i, own in enumerate(lists):
                raw = x[i].tobytes()
                for where in own.tolist():
                    blocks, asked = int(index.blocks[where]), int(index.query_blocks[where])
                    many, one = (blocks, asked) if queries else (asked, blocks)
                    mine = int(salt[i]) % one
                    for k in range(many):
                        rows["list"].append(where)
                        rows["block"].append(k if queries else mine)
                        rows["query_block"].append(mine if queries else k)
                        rows["vec_id"].append(int(ids[i]))
                        rows["vector"].append(raw)
            yield from columns(rows, PLACED).to_batches()

    return vectors.where(F.size("embedding") == len(index.rotation)).mapInArrow(run, PLACED)


def scan(query: np.ndarray, own: int, turned: np.ndarray, columns_: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, epsilon: float):
    """(ids, distances) of the k nearest of one block found by the adaptive scan. columns_: rotated vectors by dimension."""
    dims = len(columns_)
    alive = np.flatnonzero(ids != own)
    kept, alive = alive[: 4 * k], alive[4 * k :]  # measured in full, they give the first bound
    dist = np.sqrt(((vectors[kept] - query) ** 2).sum(1))
    while len(alive):
        now, alive = alive[:SCAN], alive[SCAN:]
        bound = np.partition(dist, k - 1)[k - 1] ** 2 if len(dist) >= k else np.inf
        part = np.zeros(len(now))
        for a in range(0, dims, STEP):
            b = min(dims, a + STEP)
            part += ((columns_[a:b, now] - turned[a:b, None]) ** 2).sum(0)
            if b < dims:
                stay = part <= bound * b / dims * (1 + epsilon / np.sqrt(b)) ** 2
                now, part = now[stay], part[stay]
        kept = np.concatenate([kept, now])
        dist = np.concatenate([dist, np.sqrt(((vectors[now] - query) ** 2).sum(1))])
        if len(kept) > k:
            best = np.lexsort((ids[kept], dist))[:k]
            kept, dist = kept[best], dist[best]
    best = np.lexsort((ids[kept], dist))[:k]
    return ids[kept[best]], dist[best]


def search(vectors: DataFrame, queries: DataFrame, index: Index | None, k: int = 10, epsilon: float = 2.1) -> DataFrame:
    """The k nearest other rows of each query: query_id, rank (from 1), vec_id, score (Euclidean distance, double).

    vectors, queries: vec_id long, embedding array of numbers; other columns are not read. Rows whose vector is null,
    zero, or holds null or non-finite components take no part, nor do those of another length than most. Equal
    distances are ordered by vec_id; a repeated vec_id counts as one candidate. An empty table gives no rows.
    epsilon: how many standard deviations a partial distance must exceed the bound by before a candidate is given up.
    A list is scanned in blocks of bounded size, so a list with most of the rows is many tasks. Queries for which the
    probed lists give fewer than k are searched again in all lists.
    """
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def meet(key, left, right):
        if not left.num_rows or not right.num_rows:
            return columns({"query_id": [], "vec_id": [], "score": []}, FOUND)
        ids = left.column("vec_id").to_numpy()
        x = np.frombuffer(b"".join(left.column("vector").to_pylist()), float).reshape(len(ids), -1)
        ids, some = np.unique(ids, return_index=True)
        x = x[some]
        by_dimension = np.ascontiguousarray((x @ index.rotation).T)
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for own, raw in zip(right.column("vec_id").to_pylist(), right.column("vector").to_pylist(), strict=True):
            q = np.frombuffer(raw, float)
            found, dist = scan(q, own, q @ index.rotation, by_dimension, ids, x, k, epsilon)
            out["query_id"] += [own] * len(found)
            out["vec_id"] += found.tolist()
            out["score"] += dist.tolist()
        return columns(out, FOUND)

    at = ("list", "block", "query_block")

    def met(rows: DataFrame, asked: DataFrame, probes: int) -> DataFrame:
        left = placed(rows, index, False).groupBy(*at)
        return left.cogroup(placed(asked, index, True, probes).groupBy(*at)).applyInArrow(meet, FOUND).distinct()

    rows, asked, lists = usable(vectors), usable(queries), len(index.centroids)
    found = met(rows, asked, index.probes)
    if index.probes < lists:
        enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
        short = asked.join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        some = short.agg(F.count("*").alias("_short")).where("_short > 0")  # no row: the vectors are not dealt again
        found = found.union(met(rows.join(F.broadcast(some)).drop("_short"), short, lists))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vector_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 100 = 0"), build(usable(vectors), 0.01))
