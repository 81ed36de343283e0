"""Recurrences over long keys, cut into blocks of time.

Rows are dealt out by key and block of time, so a key with most of the rows is
spread over as many tasks as it spans blocks. Three passes, the same for every
table and every number of partitions:

1. every block is summarised as a map from the state at its start to the state
   at its end (`Splittable.summarise`), a few numbers each;
2. the maps of a key are applied one after the other, which gives the state at
   the start of every block: one row a block, streamed;
3. the rows run again, each block from its own state.

The maps are exact, so nothing is iterated. No action runs while the plan is
built, and no figure about the data decides its shape.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expr import seconds_to_us
from tidemark.operators.scan import Recurrence, key_at, key_starts

BLOCK_SECONDS = 86400.0


class Splittable(Recurrence):
    """A recurrence whose effect on a run of rows is a small map of the state.

    `summarise` gives the map of each run of a batch, a picklable value; `advance` applies one to a state (None before
    the first row of a key); `resume` gives the output columns of runs that begin with the given states, and the state
    after the last (`every`: after each). needs: columns that `summarise` reads besides keys and order.
    """

    needs: list[str] = []

    def summarise(self, batch: pa.RecordBatch, starts: np.ndarray) -> list:
        raise NotImplementedError

    def advance(self, state, piece):
        raise NotImplementedError

    def resume(self, batch: pa.RecordBatch, starts: np.ndarray, states: dict, *, every: bool = False):
        raise NotImplementedError

    def run(self, batch, first, carry):
        starts = np.flatnonzero(np.r_[True, first[1:]])
        return self.resume(batch, starts, {} if first[0] or carry is None else {0: carry})

    def run_each(self, batch, starts, carries):
        states = {a: c for a, c in zip(starts.tolist(), carries, strict=True) if c is not None}
        return self.resume(batch, starts, states, every=True)


def block_of(time: str, block_seconds: float) -> Column:
    """Number of the time block; rows without a time are in one before all others, as they sort first."""
    return F.coalesce(F.floor(F.unix_micros(time) / seconds_to_us(block_seconds)), F.lit(-(1 << 62)).cast("long"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """(batch, true where a group begins, whether row 0 goes on with the group before) of non-empty batches."""
    before = None
    for batch in batches:
        if batch.num_rows:
            first = key_starts(batch, keys)
            goes_on = before is not None and key_at(batch, keys, 0) == before
            before = key_at(batch, keys, batch.num_rows - 1)
            yield batch, first, goes_on


def split_scan(df: DataFrame, keys: list[str], order: list[str], rec: Splittable, *, block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Appends the columns of `rec` to df; order[0] is the time that blocks go by. `df` is read twice."""
    group = [*keys, "_block"]
    rows = df.withColumn("_block", block_of(order[0], block_seconds))
    narrow = rows.select(*dict.fromkeys([*group, *order, *rec.needs]))
    key_fields = [f for f in narrow.schema.fields if f.name in group]
    key_fields.sort(key=lambda f: group.index(f.name))

    def summaries(batches):
        piece = 0
        for batch, first, _ in _grouped(batches, group):
            starts = np.flatnonzero(first)
            bodies = [pickle.dumps(x) for x in rec.summarise(batch, starts)]
            at = pa.array(starts)
            columns = [batch.column(k).take(at) for k in group]
            numbers = pa.array(np.arange(piece, piece + len(starts)))
            piece += len(starts)
            yield pa.RecordBatch.from_arrays([*columns, numbers, pa.array(bodies, pa.binary())], names=[*group, "_piece", "_body"])

    def entries(batches):
        key, block, state = None, None, None
        for batch in batches:
            cells = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            found, states = [], []
            for i, (k, b, body) in enumerate(zip(cells, batch.column("_block").to_pylist(), batch.column("_body").to_pylist(), strict=True)):
                if k != key:
                    key, block, state = k, None, None
                if b != block:
                    block = b
                    if state is not None:
                        found.append(i)
                        states.append(pickle.dumps(state))
                state = rec.advance(state, pickle.loads(body))
            if found:
                columns = [batch.column(k).take(pa.array(found)) for k in group]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(states, pa.binary())], names=[*group, "_entry"])

    pieces_type = T.StructType([*key_fields, T.StructField("_piece", T.LongType()), T.StructField("_body", T.BinaryType())])
    entry_type = T.StructType([*key_fields, T.StructField("_entry", T.BinaryType())])
    pieces = narrow.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(summaries, pieces_type)
    entry = pieces.repartition(*keys).sortWithinPartitions(*group, "_piece").mapInArrow(entries, entry_type)

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in rec.fields]])
    names, kept_names = schema.names, df.columns

    def resumed(batches):
        pending = None
        for batch, first, goes_on in _grouped(batches, group):
            is_entry = batch.column("_entry").is_valid().to_numpy(zero_copy_only=False)
            rows_at = np.flatnonzero(~is_entry)
            new_index = np.cumsum(~is_entry) - (~is_entry)
            states = {} if not goes_on or pending is None else {0: pending}
            pending = pending if goes_on else None
            for i in np.flatnonzero(is_entry):
                pending = pickle.loads(batch.column("_entry")[int(i)].as_py())
                states[int(new_index[i])] = pending
            if not len(rows_at):
                continue
            # a group begins at its first row that is no entry
            opens = first.copy()
            opens[1:] |= is_entry[:-1]
            starts = np.flatnonzero(np.r_[True, opens[rows_at][1:]])
            kept = batch.take(pa.array(rows_at)).select(kept_names)
            outputs, last = rec.resume(kept, starts, {i: s for i, s in states.items() if i < len(rows_at)})
            if not is_entry[-1]:
                pending = last
            yield pa.RecordBatch.from_arrays([*kept.columns, *outputs], names=names)

    both = rows.withColumn("_entry", F.lit(None).cast("binary")).unionByName(entry, allowMissingColumns=True)
    dealt = both.repartition(*group).sortWithinPartitions(*group, F.col("_entry").isNull(), *order)
    return dealt.mapInArrow(resumed, schema)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, *, block_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Adds the 0-based position of each row in the order of its key; order[0] is the time that blocks go by.

    Rows are numbered within blocks of time; the few block sizes of a key are summed up and joined back by key and block.
    """
    group = [*keys, "_block"]
    rows = df.withColumn("_block", block_of(order[0], block_seconds))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_ahead"))
    inside = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    there = ahead.select(*[F.col(c).alias(f"_of_{c}") for c in group], "_ahead")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    return inside.join(there, reduce(and_, same)).withColumn(name, F.col("_ahead") + F.col("_local") - 1).select(*df.columns, name)
