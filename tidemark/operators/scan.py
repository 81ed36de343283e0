"""Ordered passes: per-key recurrences over rows in time order.

A recurrence (running average, greedy selection, online model) sees the rows
of one key in order and carries a small state. `ordered_scan` hash-partitions
rows by key and sorts them, one shuffle; each task streams its rows in Arrow
batches, so memory does not grow with a key. Recurrences that can be cut run
by `split_scan` instead, which spreads a long key over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpointed

PARTITION_ROWS = 2_000_000  # aim of a range partition


class Recurrence:
    """One recurrence. `run` is vectorised over a batch that may hold many keys.

    first[i] is True where row i opens a new key. `carry` is the state of the
    key that continues from the previous batch (None when row 0 opens one);
    `run` returns its output columns and the state of the last key. States are
    plain picklable values.
    """

    fields: list[tuple[str, T.DataType]] = []

    def run(self, batch: pa.RecordBatch, first: np.ndarray, carry):
        raise NotImplementedError

    def run_each(self, batch: pa.RecordBatch, starts: np.ndarray, carries: list):
        """Runs that begin at `starts`, each from its own state (None: a new key); output columns, and the state after each."""
        parts, after = [], []
        for a, b, carry in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], carries, strict=True):
            first = np.zeros(b - a, dtype=bool)
            first[0] = carry is None
            columns, state = self.run(batch.slice(a, b - a), first, carry)
            parts.append(columns)
            after.append(state)
        return [pa.concat_arrays(some) for some in zip(*parts, strict=True)], after


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def key_at(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def key_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where the key differs from the row before; row 0 is left True."""
    first = np.zeros(batch.num_rows, dtype=bool)
    first[0] = True
    for k in keys:
        codes = _codes(batch.column(k))
        first[1:] |= codes[1:] != codes[:-1]
    return first


def _stream(batches: Iterator[pa.RecordBatch], keys, recurrences):
    """Run the recurrences over sorted batches; yields (batch, outputs)."""
    prev_key, carries = None, [None] * len(recurrences)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        first = key_starts(batch, keys)
        first[0] = prev_key is None or key_at(batch, keys, 0) != prev_key
        if first[0]:
            carries = [None] * len(recurrences)
        outputs = []
        for i, rec in enumerate(recurrences):
            cols, carries[i] = rec.run(batch, first, carries[i])
            outputs += cols
        prev_key = key_at(batch, keys, batch.num_rows - 1)
        yield batch, outputs


def _output_schema(df: DataFrame, recurrences) -> T.StructType:
    extra = [T.StructField(n, t) for rec in recurrences for n, t in rec.fields]
    return T.StructType(df.schema.fields + extra)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    recurrences: list[Recurrence],
    *,
    co_partitioned: bool = False,
) -> DataFrame:
    """Append the recurrences' columns to `df`. `co_partitioned` skips the
    shuffle when rows of a key already share a partition."""
    schema = _output_schema(df, recurrences)
    names = schema.names

    def task(batches):
        for batch, outputs in _stream(batches, keys, recurrences):
            yield pa.RecordBatch.from_arrays([*batch.columns, *outputs], names=names)

    if not co_partitioned:
        df = df.repartition(*keys)
    return df.sortWithinPartitions(*keys, *order).mapInArrow(task, schema)


def number_rows(df: DataFrame, order: list[str], name: str, *, partitions: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row in the whole table's order.

    Rows are range-partitioned and counted per partition; only those counts
    (one per partition) meet on the driver.
    """
    if partitions is None:
        partitions = df.count() // PARTITION_ROWS + 1
    ranged = checkpointed(
        df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    )
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    offsets, total = {}, 0
    for part in sorted(counts):
        offsets[part] = total
        total += counts[part]
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.LongType())])
    names = schema.names

    def task(batches):
        head, batches = _peek(batches)
        if head is None:
            return
        at = head.schema.get_field_index("_part")
        position = offsets[head.column("_part")[0].as_py()]
        for batch in batches:
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            numbers = pa.array(np.arange(position, position + batch.num_rows))
            position += batch.num_rows
            yield pa.RecordBatch.from_arrays([*kept, numbers], names=names)

    return ranged.mapInArrow(task, schema)


def _peek(batches):
    batches = (b for b in batches if b.num_rows)
    head = next(batches, None)

    def again():
        if head is not None:
            yield head
            yield from batches

    return head, again()


def micros(column: pa.Array) -> np.ndarray:
    return column.cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()).to_numpy(zero_copy_only=False)


def run_bounds(first: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal keys (row 0 always starts one), plus the end."""
    starts = np.flatnonzero(first)
    if len(starts) == 0 or starts[0] != 0:
        starts = np.r_[0, starts]
    return np.r_[starts, len(first)]


class OpenWindow(Recurrence):
    """Number of the newest window opened so far, counting fixed windows from
    the key's first arrival, in arrival order. Rows older than it are late."""

    fields = [("window_no", T.LongType()), ("open_window", T.LongType())]

    def __init__(self, time: str, size_us: int):
        self.time = time
        self.size = size_us

    def run(self, batch, first, carry):
        t = micros(batch.column(self.time))
        bounds = run_bounds(first)
        number = np.empty(len(t), dtype=np.int64)
        newest = np.empty(len(t), dtype=np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            anchor, seen = carry if (lo == 0 and carry is not None) else (int(t[lo]), 0)
            number[lo:hi] = (t[lo:hi] - anchor) // self.size
            newest[lo:hi] = np.maximum(np.maximum.accumulate(number[lo:hi]), seen)
        return [pa.array(number), pa.array(newest)], (anchor, int(newest[-1]))
