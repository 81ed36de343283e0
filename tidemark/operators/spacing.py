"""Greedy selection of rows a minimum time apart."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tidemark.operators.scan import micros
from tidemark.operators.split_scan import Splittable


class Spacing(Splittable):
    """Keep the first row of a key, then each row at least `gap` after the last
    kept one (more than `gap` when strict).

    Columns: kept, and prev_anchor, the time of the last row kept before this.
    The state is the time of the last kept row. Which rows of a run are kept
    depends on the first one that is, so a run's map is a step function: for
    each row that can be the first, the row kept last.
    """

    def __init__(self, time: str, gap_us: int, *, strict: bool = False):
        self.time = time
        self.need = gap_us + (1 if strict else 0)
        self.fields = [("kept", T.BooleanType()), ("prev_anchor", T.TimestampType())]
        self.needs = [time]

    def summarise(self, batch, starts):
        t = micros(batch.column(self.time))
        ends = np.r_[starts[1:], len(t)]
        single = (ends - starts == 1).tolist()  # most runs of a small key
        bounds = zip(starts.tolist(), ends.tolist(), t[starts].tolist(), single, strict=True)
        return [([at], [at]) if alone else self._map(t[a:b]) for a, b, at, alone in bounds]

    def _map(self, t: np.ndarray) -> tuple[list[int], list[int]]:
        """(times, ends): entered so that the first row kept is the first at or after some time, the last kept is at the end of that time."""
        if self.need == 0:
            return [int(t[-1])], [int(t[-1])]
        if t[-1] - t[0] < self.need:  # room for one
            times = np.unique(t).tolist()
            return times, times
        n = len(t)
        onward = np.searchsorted(t, t + self.need)
        onward = np.where(onward < n, onward, np.arange(n))
        while (onward[onward] != onward).any():  # pointer doubling to the end of each chain
            onward = onward[onward]
        # the state is not after t[0], so the first row kept is among these
        some = min(n, int(np.searchsorted(t, t[0] + self.need)) + 1)
        ends = t[onward[:some]]
        last = np.r_[ends[1:] != ends[:-1], True]
        return t[:some][last].tolist(), ends[last].tolist()

    def advance(self, state, piece):
        times, ends = piece
        at = 0 if state is None else bisect_left(times, state + self.need)
        return ends[at] if at < len(ends) else state

    def resume(self, batch, starts, states, *, every=False):
        t = micros(batch.column(self.time))
        n, need = len(t), self.need
        entry = np.zeros(len(starts), np.int64)
        known = np.zeros(len(starts), bool)
        for k, i in enumerate(starts.tolist()):
            if i in states:
                entry[k], known[k] = states[i], True
        opens = np.zeros(n, bool)
        opens[starts] = True
        kept = np.full(n, need == 0)
        # a row this far from the row before it is kept whatever was kept earlier
        kept[1:] |= np.diff(t) >= need
        kept[starts] = ~known | (t[starts] - entry >= need)
        # runs that begin with a kept row, or with a key whose last kept row lies before
        begin = np.flatnonzero(kept | opens)
        end = np.r_[begin[1:], n]
        of_start = np.searchsorted(starts, begin, "right") - 1
        anchors = np.where(kept[begin], t[begin], entry[of_start])
        if need:
            for i in np.flatnonzero(t[end - 1] - anchors >= need):
                lo, hi, anchor = int(begin[i]), int(end[i]), anchors[i]
                while True:
                    lo = lo + int(np.searchsorted(t[lo:hi], anchor + need))
                    if lo >= hi:
                        break
                    kept[lo] = True
                    anchor = t[lo]
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        at = np.maximum.accumulate(np.where(kept, np.arange(n), -1))
        own = at >= starts[group]  # the last kept row up to here is of this key
        last = np.where(own, t[np.maximum(at, 0)], entry[group])
        prev = np.r_[0, last[:-1]]
        prev[starts] = entry
        none = np.zeros(n, bool)
        none[starts] = ~known
        column = pa.array(prev, pa.int64(), mask=none).cast(pa.timestamp("us", tz="UTC"))
        return [pa.array(kept), column], last[np.r_[starts[1:], n] - 1].tolist() if every else int(last[-1])
