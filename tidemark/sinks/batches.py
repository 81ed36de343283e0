"""Tables that grow by batches, each of which counts once.

A batch is written as a folder of its own (by tenant and date) and counts from
the moment its manifest is there, a small file moved into place as one step.
A job that dies before that leaves rows no reader sees, and its next attempt
writes over them; a batch whose manifest is there is not written again. So a
stream that repeats a micro-batch after a failure changes nothing.

The manifest lists the (tenant, date) pairs of the batch. Readers of a range,
and the check for rows that an earlier batch stored, open only the folders of
the pairs they need, without listing the others.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.metrics import newest
from tidemark.sinks.tables import PARTITIONS, SORT, between, dated

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of a null
FEW_KEYS = 100_000  # repeated keys that are sent to every task


@dataclass(frozen=True)
class Manifest:
    batch: str
    pairs: tuple[tuple[str, str], ...]  # folders of tenant and date
    replaces: tuple[str, ...] = ()  # batches whose rows this one holds for its pairs
    whole: bool = False  # they are replaced for all of their pairs


def once(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key. Two hashes of the keys are shuffled, and then only rows whose key comes twice.

    Where very many keys do, all rows are shuffled.
    """
    hashes = {"_h0": F.xxhash64(*key), "_h1": F.xxhash64(F.lit(1), *key)}
    spark, counted = rows.sparkSession, rows.select(*[h.alias(n) for n, h in hashes.items()]).groupBy(*hashes).count()
    found = counted.where("count > 1").drop("count").limit(FEW_KEYS + 1).collect()
    if not found:
        return rows
    if len(found) > FEW_KEYS:
        return rows.dropDuplicates(key)
    marked, twice = rows.withColumns(hashes), F.broadcast(spark.createDataFrame(found, "_h0 long, _h1 long"))
    alone, repeated = (marked.join(twice, [*hashes], how).drop(*hashes) for how in ("left_anti", "left_semi"))
    return alone.unionByName(repeated.dropDuplicates(key))


class BatchTable:
    """A table under `path`, a folder all executors share.

    time: the column that `date` follows. key: columns that name a row; one that an earlier batch has stored under the
    same tenant and date is not stored again. Without a key only whole batches are told apart.
    """

    def __init__(self, spark: SparkSession, path: str, *, time: str = "timestamp", key: tuple[str, ...] = ()):
        self.spark, self.path, self.time, self.key = spark, path.rstrip("/"), time, key
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest_path(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch[0] in "._":
            raise ValueError(f"no batch id: {batch!r}")
        return f"{self.path}/_batches/{batch}.json"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._at(self._manifest_path(batch)))

    def manifests(self) -> list[Manifest]:
        """All batches that count."""
        folder = f"{self.path}/_batches"
        if not any(n.endswith(".json") for n in self._names(folder)):
            return []
        found = self.spark.read.text(f"{folder}/*.json", wholetext=True).collect()
        return sorted((Manifest(m["batch"], tuple(map(tuple, m["pairs"])), tuple(m["replaces"]), m["whole"]) for m in (json.loads(r.value) for r in found)), key=lambda m: m.batch)

    def _commit(self, manifest: Manifest) -> None:
        draft = self._at(f"{self.path}/_batches/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        if not self._fs.rename(draft, self._at(self._manifest_path(manifest.batch))):
            self._fs.delete(draft, False)
            raise RuntimeError(f"batch {manifest.batch} was committed by another job")

    def _folders(self, pairs=None) -> list[str]:
        """Folders of committed batches that hold one of the pairs, or any."""
        current = self.manifests()
        dropped = {b for m in current if m.whole for b in m.replaces}
        gone = {(b, p) for m in current for b in m.replaces for p in m.pairs}
        return [
            f"{self.path}/batch={m.batch}/{tenant}/{date}"
            for m in current
            for tenant, date in m.pairs
            if m.batch not in dropped and (m.batch, (tenant, date)) not in gone and (pairs is None or (tenant, date) in pairs)
        ]

    # rows

    def write(self, batch: str, df: DataFrame) -> bool:
        """Stores a batch; False if it was stored before."""
        if self.committed(batch):
            return False
        self._store(batch, dated(df, self.time), (), once_only=bool(self.key))
        return True

    def stored(self, batch: str) -> DataFrame | None:
        """Rows of a committed batch, as long as no other has replaced them; None where it has none."""
        rows = self._read([f for f in self._folders() if f.startswith(f"{self.path}/batch={batch}/")])
        return None if rows is None else rows.drop("batch")

    def _folder(self, column: str, value) -> str:
        """Name of a partition's folder, with odd characters escaped as Spark does."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{column}={NO_VALUE if value in (None, '') else escape(str(value))}"

    def _store(self, batch: str, rows: DataFrame, replaces: tuple[str, ...], whole: bool = False, once_only: bool = False) -> None:
        """Writes rows in one pass over them. once_only: and leaves one row of each key, by what was written, before the batch counts."""
        out = f"{self.path}/batch={batch}"
        packed = bool(replaces) and not whole
        pairs = self._put(out, rows if packed else rows.hint("rebalance", *PARTITIONS), "zstd" if packed else "snappy")
        if once_only and (fresh := self._fresh(out, pairs)) is not None:
            draft = f"{self.path}/_once-{batch}"
            pairs = self._put(draft, fresh.hint("rebalance", *PARTITIONS), "snappy")
            self._fs.delete(self._at(out), True)
            if not self._fs.rename(self._at(draft), self._at(out)):
                raise RuntimeError(f"{draft} can't be moved into place")
        self._commit(Manifest(batch, pairs, replaces, whole))

    def _put(self, out: str, rows: DataFrame, compression: str) -> tuple[tuple[str, str], ...]:
        rows.write.mode("overwrite").option("compression", compression).partitionBy(*PARTITIONS).parquet(out)
        return tuple((t, d) for t in self._names(out) if "=" in t for d in self._names(f"{out}/{t}") if "=" in d)

    def _fresh(self, out: str, pairs: tuple[tuple[str, str], ...]) -> DataFrame | None:
        """Of the rows under `out` those to keep: one of each key, and none that an earlier batch has stored. None if these are all."""
        written = self._read([f"{out}/{t}/{d}" for t, d in pairs])
        if written is None:
            return None
        written = written.drop("batch")
        rows, stored = once(written, list(self.key)), self._read(self._folders(set(pairs)))
        if stored is not None:
            columns = [*self.key, *PARTITIONS]
            name = [F.xxhash64(*columns).alias("_h0"), F.xxhash64(F.lit(1), *columns).alias("_h1")]
            if written.select(*name).join(stored.select(*name), ["_h0", "_h1"], "left_semi").limit(1).collect():
                same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in columns]
                condition = same[0]
                for c in same[1:]:
                    condition = condition & c
                return rows.alias("n").join(stored.select(*columns).alias("s"), condition, "left_anti")
        return None if rows is written else rows

    def _read(self, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        types = T.StructType([T.StructField("batch", T.StringType()), T.StructField("tenant_id", T.StringType()), T.StructField("date", T.DateType())])
        sample = self.spark.read.parquet(folders[0]).schema
        kept = [f for f in sample.fields if f.name not in types.names]
        reader = self.spark.read.schema(T.StructType([*kept, *types.fields])).option("basePath", self.path)
        return reader.parquet(*folders)

    def dates(self, tenants: list[str] | None = None) -> list[str]:
        """Dates that hold rows (of some tenants), newest first; from the manifests alone."""
        wanted = None if tenants is None else {self._folder("tenant_id", t) for t in tenants}
        found = {f.rsplit("date=", 1)[1] for f in self._folders() if wanted is None or f.split("/")[-2] in wanted}
        return sorted(found - {NO_VALUE}, reverse=True)

    def read(self, since: str | None = None, until: str | None = None, tenants: list[str] | None = None) -> DataFrame:
        """Rows of all committed batches, or those of a time range and of some tenants: other folders are not opened."""
        day = lambda text: dt.datetime.fromisoformat(text).date().isoformat() if text else None
        low, high = day(since), day(until)
        inside = lambda d: (low is None or d >= low) and (high is None or d <= high)
        wanted = None if tenants is None else {self._folder("tenant_id", t) for t in tenants}
        folders = [
            f for f in self._folders()
            if (wanted is None or f.split("/")[-2] in wanted) and ((low is None and high is None) or inside(f.rsplit("date=", 1)[1]))
        ]
        rows = self._read(folders)
        if rows is None:
            raise FileNotFoundError(f"no batch in {self.path} holds such rows")
        return between(rows.drop("batch"), since, until, self.time)

    def compact(self, batch: str, older_than_days: int, as_of: str) -> bool:
        """Rewrites the dates before as_of - older_than_days into one batch of few sorted files that replaces the others
        for these dates; rows and their number stay as they are. False if that was done before."""
        if self.committed(batch):
            return False
        cutoff = (dt.datetime.fromisoformat(as_of) - dt.timedelta(days=older_than_days)).date().isoformat()
        old = [m for m in self.manifests()]
        folders = [f for f in self._folders() if not f.endswith(f"date={NO_VALUE}") and f.rsplit("date=", 1)[1] < cutoff]
        rows = self._read(folders)
        if rows is None:
            return False
        order = [c for c in SORT if c in rows.columns]
        ranged = rows.drop("batch").repartitionByRange(*PARTITIONS, *order).sortWithinPartitions(*PARTITIONS, *order)
        used = {f.rsplit("/batch=", 1)[1].split("/")[0] for f in folders}
        self._store(batch, ranged, tuple(m.batch for m in old if m.batch in used))
        return True

    def vacuum(self) -> list[str]:
        """Deletes folders that no reader sees: of replaced rows and of attempts that never counted."""
        seen = {f.removeprefix(f"{self.path}/") for f in self._folders()}
        batches = {f.split("/")[0] for f in seen}
        gone = [b for b in self._names(self.path) if b.startswith("batch=") and b not in batches]
        for b in batches:
            for t in self._names(f"{self.path}/{b}"):
                if "=" in t:
                    gone += [f"{b}/{t}/{d}" for d in self._names(f"{self.path}/{b}/{t}") if "=" in d and f"{b}/{t}/{d}" not in seen]
        for folder in gone:
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)
        return sorted(gone)


class LatestTable(BatchTable):
    """The `n` newest rows of each tenant, refreshed batch by batch; a batch that is repeated changes nothing.

    Each version is a batch that replaces the one before, of at most n rows a tenant, whatever has gone by. Rows of the
    same key count once.
    """

    def __init__(self, spark: SparkSession, path: str, *, n: int, order: tuple[str, ...], key: tuple[str, ...], time: str = "timestamp"):
        super().__init__(spark, path, time=time, key=key)
        self.n, self.order = n, order

    def write(self, batch: str, df: DataFrame) -> bool:
        if self.committed(batch):
            return False
        now = self.manifests()
        rows, old = dated(df, self.time), self._read(self._folders())
        if old is not None:
            rows = rows.unionByName(old.drop("batch"), allowMissingColumns=True)
        rows = newest(self._recent(once(rows, list(self.key))), ["tenant_id"], self.n, list(self.order))
        self._store(batch, rows, tuple(m.batch for m in now), whole=True)
        return True

    def _recent(self, rows: DataFrame) -> DataFrame:
        """Rows of the newest dates of each tenant that hold n of them, so that the others are not sorted."""
        if self.order[0] != self.time:
            return rows
        left: dict = {}
        found = []
        counts = rows.groupBy(*PARTITIONS).count().collect()  # as many as the batch writes folders
        for tenant, date, n in sorted(counts, key=lambda r: (r[1] is not None, r[1] or dt.date.min), reverse=True):
            if left.setdefault(tenant, self.n) > 0:
                found.append((tenant, date))
                left[tenant] -= n
        some = rows.sparkSession.createDataFrame(found, T.StructType([T.StructField(c, rows.schema[c].dataType) for c in PARTITIONS]))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in PARTITIONS]
        return rows.alias("r").join(F.broadcast(some).alias("s"), same[0] & same[1], "left_semi")
