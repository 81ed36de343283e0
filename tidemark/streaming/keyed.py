"""Recurrences on streams: the update functions of the batch scans with state per key.

Keys are dealt into buckets, since Spark's call for a group costs far more than
a few rows of a key do; the state stays one entry a key. A key's new rows are sorted within the micro-batch and continue from the
stored state, so that a stream fed in time order gives the batch result.

Spark hands a processor its rows one at a time as Python objects, which costs far more than the recurrences, and shuffles them
one by one. So rows are packed first: the rows of a bucket in a stretch of input are one compressed Arrow table, which goes through
the shuffle and the processor as one cell (`packed_state`).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.expr import seconds_to_us
from tidemark.operators.scan import Recurrence, key_at, key_starts, micros
from tidemark.operators.spacing import Spacing

STATE = T.StructType([T.StructField("carries", T.BinaryType())])
KEY_BYTES = T.StructType([T.StructField("key", T.BinaryType())])
BODY = T.StructType([T.StructField("body", T.BinaryType())])
DEALT = T.StructType([T.StructField("_bucket", T.LongType()), *BODY.fields])
PACK_BYTES = 32 << 20  # rows that a task holds to deal them out
OUT_ROWS = 10_000  # rows of a processor's table, most


def key_name(cells: tuple) -> tuple[bytes]:
    """A key of the map state: the same bytes for the same values, which pickle does not promise."""
    return (repr(cells).encode(),)


def packed(state) -> bytes:
    """Plain values as bytes; counts of trees are zeros mostly."""
    return zlib.compress(pickle.dumps(state), 1)


def unpacked(body: bytes):
    return pickle.loads(zlib.decompress(body))


def dealt_out(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds _bucket, the bucket of a row's key."""
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def to_cell(table: pa.Table | pa.RecordBatch) -> bytes:
    """A table as one cell: a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out, pa.ipc.new_stream(out, table.schema) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def of_cell(cell: bytes) -> pa.Table:
    with pa.CompressedInputStream(pa.BufferReader(cell), "zstd") as body:
        return pa.ipc.open_stream(body).read_all()


def one_batch(tables: list[pa.Table | pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.concat_tables([pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t for t in tables]).combine_chunks()
    (batch,) = whole.to_batches() or [pa.RecordBatch.from_pylist([], whole.schema)]
    return batch


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (with _bucket as the last column) as cells of DEALT: a cell for each bucket and stretch of PACK_BYTES."""

    def cells(held):
        batch = one_batch(held)
        bucket = batch.column("_bucket").to_numpy(zero_copy_only=False)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = batch.select(batch.schema.names[:-1]).take(pa.array(order)), bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(bucket)]
        bodies = [to_cell(rows.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array(bodies, pa.binary())], names=DEALT.names)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield cells(held)
            held, size = [], 0
    if held:
        yield cells(held)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in cells of BODY."""
    for batch in batches:
        for cell in batch.column(0):
            yield from of_cell(cell.as_py()).to_batches()


class Packed(StatefulProcessor):
    """Runs steps over the rows of a bucket that came in cells: the first step's table goes into the next.

    A step has `init` and `handle_batch`, which takes a record batch and returns one.
    """

    def __init__(self, steps: list):
        self.steps = steps

    def init(self, handle) -> None:
        for step in self.steps:
            step.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        batch = one_batch([of_cell(cell) for frame in rows for cell in frame["body"]])
        for step in self.steps:
            batch = step.handle_batch(batch)
        for at in range(0, batch.num_rows, OUT_ROWS):
            yield pd.DataFrame({"body": [to_cell(batch.slice(at, OUT_ROWS))]})

    def close(self) -> None:
        pass


def packed_state(df: DataFrame, keys: list[str], steps: list, schema: T.StructType, *, buckets: int, time_mode: str = "None") -> DataFrame:
    """Rows of a stream through keyed steps that share their buckets, which `keys` deal out; rows of `schema`."""
    use_rocksdb(df.sparkSession)
    cells = dealt_out(df, keys, buckets).mapInArrow(_deal, DEALT).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=Packed(steps), outputStructType=BODY, outputMode="Append", timeMode=time_mode
    )
    return cells.mapInArrow(_spread, schema)


def in_order(batch: pa.RecordBatch, by: list[str]) -> pa.RecordBatch:
    """Rows sorted by some columns; rows that tie stay in the order they came in."""
    return batch.take(pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in by]))


class KeyedRecurrence(StatefulProcessor):
    """Runs recurrences for a bucket of keys; a key's state expires `ttl_seconds` after its last update, or never.

    The rows of all keys of a bucket are one batch, so that a micro-batch of very many keys costs little beyond its rows.
    Each key has an entry of its own in the map state `name`, so only the keys of a micro-batch are read and written.
    where: a boolean column, never null; rows for which it is false pass by.
    """

    def __init__(
        self,
        schema: T.StructType,
        keys: list[str],
        order: list[str],
        recurrences: list[Recurrence],
        ttl_seconds: float | None,
        name: str = "carries",
        where: str | None = None,
    ):
        self.schema = schema
        self.keys = keys
        self.order = order
        self.recurrences = recurrences
        self.ttl_ms = None if ttl_seconds is None else int(ttl_seconds * 1000)
        self.name = name
        self.where = where

    def init(self, handle) -> None:
        self.state = handle.getMapState(self.name, KEY_BYTES, STATE, ttlDurationMs=self.ttl_ms)

    def handle_batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = in_order(batch, [*self.keys, *self.order])
        if self.where is None:
            outputs = self._advance(batch)
        else:  # the others get nulls
            seen = batch.column(self.where)
            place = pc.if_else(seen, pc.subtract(pc.cumulative_sum(seen.cast(pa.int64())), 1), None)
            some = batch.filter(seen)
            outputs = [(n, c.take(place)) for n, c in self._advance(some)] if some.num_rows else [
                (f.name, pa.nulls(batch.num_rows, f.type)) for f in to_arrow_schema(T.StructType([T.StructField(*x) for r in self.recurrences for x in r.fields]))
            ]
        return pa.RecordBatch.from_arrays([*batch.columns, *(c for _, c in outputs)], names=[*batch.schema.names, *(n for n, _ in outputs)])

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.sort_values([*self.keys, *self.order], kind="stable", ignore_index=True)
        outputs = self._advance(self._to_arrow(frame))
        yield frame[self.schema.names].assign(**{name: column.to_pandas().to_numpy() for name, column in outputs})

    def _advance(self, batch: pa.RecordBatch) -> list[tuple[str, pa.Array]]:
        """The recurrences' columns for sorted rows; the state of their keys moves on."""
        starts = np.flatnonzero(key_starts(batch, self.keys))
        names = [key_name(key_at(batch, self.keys, i)) for i in starts.tolist()]
        known = [self.state.getValue(name) for name in names]
        states = [[None] * len(self.recurrences) if s is None else unpacked(s[0]) for s in known]
        outputs = []
        for i, rec in enumerate(self.recurrences):
            columns, after = rec.run_each(batch, starts, [s[i] for s in states])
            for state, carry in zip(states, after, strict=True):
                state[i] = carry
            outputs += [(name, column) for (name, _), column in zip(rec.fields, columns)]
        for name, state in zip(names, states, strict=True):
            self.state.updateValue(name, (packed(state),))
        return outputs

    def _to_arrow(self, frame: pd.DataFrame) -> pa.RecordBatch:
        columns = []
        for field in to_arrow_schema(self.schema):
            series = frame[field.name]
            if pa.types.is_timestamp(field.type):
                series = pd.to_datetime(series, utc=True)
                columns.append(pa.array(series, pa.timestamp("us", tz="UTC")))
            elif pa.types.is_map(field.type):
                entries = [list(m.items()) if isinstance(m, dict) else m for m in series]
                columns.append(pa.array(entries, field.type))
            else:
                columns.append(pa.Array.from_pandas(series, type=field.type))
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)

    def close(self) -> None:
        pass


class BucketSpacing:
    """The greedy spacing of very many short-lived keys: a bucket of keys is one state and one array operation.

    The state holds, per key, the time of the last kept row, as long as it is at most `keep_us` behind the latest time.
    """

    def __init__(self, key: str, order: list[str], spacing: Spacing, keep_us: int):
        self.key, self.order, self.spacing, self.keep = key, order, spacing, keep_us

    def init(self, handle) -> None:
        self.state = handle.getValueState("kept", STATE)

    def handle_batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = in_order(batch, [self.key, *self.order])
        known, latest = pickle.loads(self.state.get()[0]) if self.state.exists() else ({}, None)
        keys = batch.column(self.key).to_pylist()
        starts = np.flatnonzero(key_starts(batch, [self.key]))
        states = {i: known[keys[i]] for i in starts.tolist() if keys[i] in known}
        (kept, _), _ = self.spacing.resume(batch, starts, states)
        at = micros(batch.column(self.spacing.time))
        latest = int(at.max()) if latest is None else max(latest, int(at.max()))
        oldest = latest - self.keep
        known = {k: t for k, t in known.items() if t >= oldest}
        fresh = np.flatnonzero(kept.to_numpy(zero_copy_only=False) & (at >= oldest))
        known.update((keys[i], t) for i, t in zip(fresh.tolist(), at[fresh].tolist(), strict=True))
        self.state.update((pickle.dumps((known, latest)),))
        return batch.filter(kept)


def bucket_spacing(df: DataFrame, key: str, order: list[str], spacing: Spacing, *, keep_seconds: float, buckets: int) -> DataFrame:
    """The rows of a stream that `spacing` keeps for each value of `key`, whose rows arrive out of order by keep_seconds at most."""
    step = BucketSpacing(key, order, spacing, seconds_to_us(keep_seconds))
    return packed_state(df, [key], [step], df.schema, buckets=buckets)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed processors need."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def keyed_steps(
    df: DataFrame, order: list[str], steps: list[tuple[list[str], list[Recurrence]]], *, ttl_seconds: float | None, buckets: int = 512, where: str | None = None
) -> DataFrame:
    """Several `keyed_scan`s, each of keys and recurrences, with one shuffle by the keys of the first, which those of the others contain.

    where: a boolean column, never null; rows for which it is false pass by, with nulls in the new columns.
    """
    schema, run = df.schema, []
    for i, (keys, recurrences) in enumerate(steps):
        if not set(steps[0][0]) <= set(keys):
            raise ValueError(f"{keys} do not contain {steps[0][0]}")
        run.append(KeyedRecurrence(schema, keys, order, recurrences, ttl_seconds, "carries" if i == 0 else f"carries{i}", where))
        schema = T.StructType(schema.fields + [T.StructField(n, t) for rec in recurrences for n, t in rec.fields])
    return packed_state(df, steps[0][0], run, schema, buckets=buckets, time_mode="None" if ttl_seconds is None else "ProcessingTime")


def keyed_scan(
    df: DataFrame, keys: list[str], order: list[str], recurrences: list[Recurrence], *, ttl_seconds: float | None, buckets: int = 512
) -> DataFrame:
    """Streaming counterpart of `ordered_scan`: appends the recurrences' columns.

    A job that runs on needs a time to live. It goes by the clock and keeps
    batches coming to clean up, so a bounded run (trigger availableNow) would
    never end with one: such runs pass None. Keys are dealt into `buckets`.
    """
    return keyed_steps(df, order, [(keys, recurrences)], ttl_seconds=ttl_seconds, buckets=buckets)
