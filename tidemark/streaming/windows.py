"""Windows anchored at a device's first event, and snapshots of the open one, as streams.

Devices are dealt into buckets, each handled in one call. A device's state is the open window: its number, the time of the last emission,
and per metric the sums that its statistics need, once for the events of the
window and once for the whole buffer, late events included. It does not grow
with the events of a window.

Order "event": events wait in a list until the watermark has passed them, which
an event-time timer tells, and are then handled in the order of their time, so
that the rows are those of the batch operators. Order "arrival": events are
handled as they come; late ones are in the next snapshots, never in a window.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.expr import seconds_to_us
from tidemark.operators.windows import KEY
from tidemark.streaming.keyed import KEY_BYTES, dealt_out, key_name, packed, packed_state, unpacked, use_rocksdb

WINDOW, SNAPSHOT = "window", "snapshot"
FEW = 16  # events added one by one; an array does not pay for so few
BYTES = T.StructType([T.StructField("body", T.BinaryType())])
EMITTED = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEY]
    + [T.StructField("kind", T.StringType()), T.StructField("window_no", T.LongType())]
    + [T.StructField(c, T.TimestampType()) for c in ("emitted_at", "window_start", "window_end")]
    + [T.StructField("field", T.StringType()), T.StructField("count", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("mean", "min", "max", "std")]
)


class Sums:
    """Statistics of events by metric: (count, mean, sum of squares around it, min, max), and first and last event time."""

    def __init__(self, fields=None, first=None, last=None):
        self.fields: dict[str, tuple[int, float, float, float, float]] = fields or {}
        self.first, self.last = first, last

    def state(self) -> tuple:
        return self.fields, self.first, self.last

    def add(self, t: list[int], metrics: list[dict]) -> None:
        if not len(t):
            return
        low, high = int(min(t)), int(max(t))
        self.first = low if self.first is None else min(self.first, low)
        self.last = high if self.last is None else max(self.last, high)
        if len(metrics) <= FEW:
            for m in metrics:
                self._one(m)
            return
        values: dict[str, list[float]] = {}
        for m in metrics:
            for name, v in m.items():
                values.setdefault(name, []).append(v)
        for name, some in values.items():
            v = np.array(some, dtype=float)
            n, mean = len(v), float(v.mean())
            square, least, most = float(((v - mean) ** 2).sum()), float(v.min()), float(v.max())
            if name in self.fields:
                n0, mean0, square0, least0, most0 = self.fields[name]
                gap, both = mean - mean0, n + n0
                square += square0 + gap * gap * n * n0 / both
                mean, n = mean0 + gap * n / both, both
                least, most = min(least, least0), max(most, most0)
            self.fields[name] = (n, mean, square, least, most)

    def _one(self, metrics: dict) -> None:
        """One event: the same steps for a single value, without arrays."""
        for name, v in metrics.items():
            v = math.nan if v is None else float(v)
            if name in self.fields:
                n0, mean0, square0, least0, most0 = self.fields[name]
                gap = v - mean0
                self.fields[name] = (n0 + 1, mean0 + gap / (n0 + 1), square0 + gap * gap * n0 / (n0 + 1), min(v, least0), max(v, most0))
            else:
                self.fields[name] = (1, v, (v - v) ** 2, v, v)

    def rows(self, kind: str, number: int, at: int | None) -> list[tuple]:
        return [
            (kind, number, at, self.first, self.last, name, n, mean, least, most, (square / n) ** 0.5)
            for name, (n, mean, square, least, most) in self.fields.items()
        ]


class OpenBuffer:
    """The open window of a device. `handle` takes events in order and returns the rows they emit."""

    def __init__(self, size_us: int, slide_us: int, state: tuple = (None, None, None, 0, (), ())):
        self.size, self.slide = size_us, slide_us
        self.anchor, self.latest, self.emitted, self.number, window, buffer = state
        self.window, self.buffer = Sums(*window), Sums(*buffer)

    def state(self) -> tuple:
        """Plain values, all that goes from one micro-batch to the next."""
        return self.anchor, self.latest, self.emitted, self.number, self.window.state(), self.buffer.state()

    def handle(self, t: np.ndarray, metrics: list[dict]) -> list[tuple]:
        out: list[tuple] = []
        if not len(t):
            return out
        if self.anchor is None:
            self.anchor = self.latest = int(t[0])
        number = (t - self.anchor) // self.size
        latest = np.maximum(np.maximum.accumulate(t), self.latest)
        newest = np.maximum(np.maximum.accumulate(number), self.number)
        rolls = set(np.flatnonzero(np.diff(newest, prepend=self.number)).tolist())
        emits = self._emissions(latest)
        cuts = sorted({0, len(t), *rolls, *(i + 1 for i in emits)})
        emits = set(emits)
        times, number, newest = t.tolist(), number.tolist(), newest.tolist()  # most cuts hold an event or two
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a in rolls:
                out += self.window.rows(WINDOW, self.number, None)
                self.window, self.buffer = Sums(), Sums()
                self.number = newest[a]
            self.buffer.add(times[a:b], metrics[a:b])
            on_time = [i for i in range(a, b) if number[i] == self.number]
            self.window.add([times[i] for i in on_time], [metrics[i] for i in on_time])
            if b - 1 in emits:
                out += self.buffer.rows(SNAPSHOT, self.number, times[b - 1])
        self.latest = int(latest[-1])
        return out

    def _emissions(self, latest: np.ndarray) -> list[int]:
        """Rows that emit: the first, then each at least a slide after the last that did."""
        at, found = 0, []
        if self.emitted is None:
            found, self.emitted, at = [0], int(latest[0]), 1
        while True:
            at += int(np.searchsorted(latest[at:], self.emitted + self.slide))
            if at >= len(latest):
                return found
            found.append(at)
            self.emitted = int(latest[at])
            at += 1


class Windows(StatefulProcessor):
    """Windows of a bucket of devices: an entry in the map state for each device, one list of waiting events."""

    def __init__(self, size_us: int, slide_us: int, in_event_order: bool):
        self.size, self.slide, self.wait = size_us, slide_us, in_event_order

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", KEY_BYTES, BYTES)
        if self.wait:
            self.waiting = handle.getListState("waiting", BYTES)

    def handle_batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Order "arrival", with the rows as a batch."""
        maps = batch.column("metrics")
        offsets = maps.offsets.to_numpy()
        first, last = int(offsets[0]), int(offsets[-1])
        fields, values = maps.keys.slice(first, last - first).to_pylist(), maps.items.slice(first, last - first).to_pylist()
        cuts = (offsets - first).tolist()
        metrics = [dict(zip(fields[a:b], values[a:b], strict=True)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        devices = zip(*(batch.column(k).to_pylist() for k in KEY), strict=True)
        rows = self._rows(list(zip(devices, *(batch.column(c).to_pylist() for c in ("at", "event_id", "us")), metrics, strict=True)))
        types = to_arrow_schema(EMITTED).types
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        arrays = [
            pa.array(c, pa.int64()).cast(pa.timestamp("us", tz="UTC")) if pa.types.is_timestamp(t) else pa.array(c, t) for c, t in zip(columns, types, strict=True)
        ]
        return pa.RecordBatch.from_arrays(arrays, names=EMITTED.names)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True)
        metrics = [dict(m) if not isinstance(m, dict) else m for m in frame["metrics"]]
        devices = zip(*(frame[k].tolist() for k in KEY), strict=True)
        events = list(zip(devices, frame["at"].tolist(), frame["event_id"].tolist(), frame["us"].tolist(), metrics, strict=True))
        first = min(e[3] for e in events)
        self.waiting.appendValue((pickle.dumps(events),))
        if first <= timerValues.getCurrentWatermarkInMs() * 1000:
            yield from self._release(timerValues)
        else:  # those that waited before have timers, and are not read for each micro-batch
            self.handle.registerTimer(-(-first // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(timerValues)

    def _release(self, timerValues):
        """Handles the waiting events that the watermark has passed, and sets a timer for the next one."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = [e for (body,) in self.waiting.get() for e in pickle.loads(body)]
        ready = [e for e in events if e[3] <= passed]
        later = [e for e in events if e[3] > passed]
        if ready or not later:
            self.waiting.put([(pickle.dumps(later),)]) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-min(e[3] for e in later) // 1000))
        if ready:
            yield from self._emit(ready)

    def _rows(self, events: list[tuple]) -> list[tuple]:
        of_device: dict[tuple, list] = {}
        for e in events:
            of_device.setdefault(e[0], []).append(e)
        rows = []
        for device, some in of_device.items():
            some.sort(key=lambda e: e[1:3])
            name = key_name(device)
            stored = self.open.getValue(name)
            buffer = OpenBuffer(self.size, self.slide, *(() if stored is None else (unpacked(stored[0]),)))
            found = buffer.handle(np.array([e[3] for e in some], np.int64), [e[4] for e in some])
            self.open.updateValue(name, (packed(buffer.state()),))
            rows += [(*device, *r) for r in found]
        return rows

    def _emit(self, events):
        rows = self._rows(events)
        if rows:
            frame = pd.DataFrame(rows, columns=EMITTED.names)
            for c in ("emitted_at", "window_start", "window_end"):
                frame[c] = pd.to_datetime(frame[c], unit="us", utc=True).dt.tz_localize(None)
            yield frame

    def close(self) -> None:
        pass


def window_stream(
    events: DataFrame, size_seconds: float = 10.0, slide_seconds: float = 2.0, *, order: str = "event", delay: str = "10 seconds", buckets: int = 512
) -> DataFrame:
    """Rows of completed windows (kind "window", as `tumbling`) and of snapshots (kind "snapshot").

    order "event" takes events in the order of their time, once the watermark, `delay` behind the newest, has passed
    them, as `running_snapshots`; those older than that are dropped. order "arrival" takes them by ingested_at, micro-batch
    by micro-batch, as `arrival_snapshots`, and drops none. A window is emitted by a later event of its device. Devices are
    dealt into `buckets`.
    """
    if order not in ("event", "arrival"):
        raise ValueError(f"order is event or arrival: {order!r}")
    by_event = order == "event"
    at = F.unix_micros("timestamp" if by_event else "ingested_at").alias("at")
    if by_event:
        events = events.withWatermark("timestamp", delay)
    narrow = events.select(*KEY, "timestamp", at, "event_id", F.unix_micros("timestamp").alias("us"), "metrics")
    windows = Windows(seconds_to_us(size_seconds), seconds_to_us(slide_seconds), by_event)
    if not by_event:
        return packed_state(narrow.drop("timestamp"), KEY, [windows], EMITTED, buckets=buckets)
    use_rocksdb(events.sparkSession)  # rows stay rows, as Spark drops those older than the watermark
    return dealt_out(narrow, KEY, buckets).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=windows, outputStructType=EMITTED, outputMode="Append", timeMode="EventTime"
    )
