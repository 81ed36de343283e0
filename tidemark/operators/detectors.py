"""The recurrences behind the anomaly scores.

Each is one small update, vectorised over Arrow batches and shared by batch
jobs and streams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from tidemark.config import Autoencoder, Drift, Ewma, HalfSpace
from tidemark.operators.scan import Recurrence, micros, run_bounds
from tidemark.operators.split_scan import Splittable

_DOUBLE = T.DoubleType()
LONG_SERIES = 64  # series of more values are averaged one by one


class EwmaScore(Splittable):
    """Exponentially weighted z-score of each metric of a device; column `statistical` is the largest.

    ewma and variance follow m' = m + a(v - m) and s' = (1-a)s + a(v - m)^2.
    The z-score uses the updated mean and is 0 until min_samples values.

    Over a run of values m is an affine function of the m before it and s adds a
    square polynomial of that m, so a run's map is five numbers a metric. They
    are taken around the run's first value, which keeps the squares accurate.
    """

    fields = [("statistical", _DOUBLE)]

    def __init__(self, cfg: Ewma = Ewma(), metrics: str = "metrics"):
        self.cfg = cfg
        self.metrics = metrics
        self.needs = [metrics]

    def _items(self, batch, starts):
        """(row, run, field code, value) of each metric, and the field names."""
        column = batch.column(self.metrics)
        offsets = column.offsets.to_numpy()
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        names = column.keys.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        values = column.items.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
        field = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return rows, np.searchsorted(starts, rows, "right") - 1, field, values, names.dictionary.to_pylist()

    def summarise(self, batch, starts):
        _, run, field, values, names = self._items(batch, starts)
        out = [{} for _ in starts]
        if not len(values):
            return out
        keep, series = 1.0 - self.cfg.alpha, run * len(names) + field
        order = np.argsort(series, kind="stable")
        s, x = series[order], values[order]
        start = np.r_[True, s[1:] != s[:-1]]
        begin = np.flatnonzero(start)
        lengths = np.diff(np.r_[begin, len(s)])
        place = np.arange(len(s)) - np.repeat(begin, lengths)
        centre = np.repeat(x[begin], lengths)
        mean = self._ewm(x - centre, s)  # the first value is 0, as is the state these begin with
        off = np.where(start, 0.0, (x - centre) - np.r_[0.0, mean[:-1]])
        weight = keep**place
        square, cross = self._ewm(off * off, s), self._ewm(off * weight, s)
        ends = begin + lengths - 1
        kept = keep**lengths
        lead = keep ** (lengths - 1) * (1.0 - kept)
        cells = zip(s[begin].tolist(), x[begin].tolist(), lengths.tolist(), kept.tolist(), mean[ends].tolist(), lead.tolist(), cross[ends].tolist(), square[ends].tolist(), strict=True)
        for code, c, n, p, m, a, b, r in cells:
            out[code // len(names)][names[code % len(names)]] = (c, n, p, m, a, -2.0 * b, r)
        return out

    def advance(self, state, piece):
        state = dict(state or {})
        for field, (c, n, p, m, a, b, r) in piece.items():
            mean, var, seen = state.get(field, (c, 0.0, 0))
            u = mean - c
            state[field] = (c + p * u + m, p * var + (a * u + b) * u + r, min(seen + n, self.cfg.history))
        return state

    def resume(self, batch, starts, states, *, every=False):
        cfg = self.cfg
        rows, run, field, values, fields = self._items(batch, starts)

        # a state carried in becomes a row in front of its series
        known = {f: i for i, f in enumerate(fields)}
        runs_of = {int(i): k for k, i in enumerate(starts)}
        led_by = [(runs_of[i], known[f], *cell) for i, state in states.items() for f, cell in state.items() if f in known]
        lead = len(led_by)
        led_by = np.array(led_by, dtype=float).reshape(lead, 5)
        all_run = np.r_[led_by[:, 0].astype(np.int64), run]
        all_field = np.r_[led_by[:, 1].astype(np.int64), field]
        v = np.r_[led_by[:, 2], values]

        series = all_run * max(1, len(fields)) + all_field
        order = np.argsort(series, kind="stable")
        s, x = series[order], v[order]
        start = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
        mean = self._ewm(x, s)
        before = np.r_[0.0, mean[:-1]]
        d2 = np.where(start, 0.0, (x - before) ** 2)
        led = order < lead
        d2[led] = led_by[order[led], 3]
        var = self._ewm(d2, s)
        base = np.zeros(len(s), dtype=np.int64)
        base[led] = led_by[order[led], 4].astype(np.int64) - 1
        begin = np.flatnonzero(start)
        lengths = np.diff(np.r_[begin, len(s)])
        count = np.arange(len(s)) - np.repeat(begin, lengths) + 1 + np.repeat(base[begin], lengths)
        count = np.minimum(count, cfg.history)
        z = np.abs(x - mean) / np.sqrt(np.maximum(var, 1e-9))
        score = np.where((count < cfg.min_samples) | start, 0.0, np.minimum(1.0, z / cfg.z_score_threshold))

        per_item = np.empty(len(s))
        per_item[order] = score
        out = np.zeros(batch.num_rows)
        np.maximum.at(out, rows, per_item[lead:])

        last_run = len(starts) - 1
        ends = np.r_[begin[1:], len(s)] - 1 if len(s) else np.empty(0, np.int64)
        if not every:
            ends = ends[all_run[order[ends]] == last_run]
        wanted = starts.tolist() if every else [int(starts[-1])]
        after = [dict(states.get(i, {})) for i in wanted]
        cells = zip(all_run[order[ends]].tolist(), all_field[order[ends]].tolist(), mean[ends].tolist(), var[ends].tolist(), count[ends].tolist(), strict=True)
        for k, code, m, square, n in cells:
            after[k if every else 0][fields[code]] = (m, square, n)
        return [pa.array(out)], after if every else after[0]

    def _ewm(self, x, series):
        """Exponentially weighted mean of each series, in the steps that pandas takes; series lie one after another.

        Short series advance together, a step for all of them at a time: most are a few values of one device and day.
        """
        if len(x) == 0:
            return x
        alpha = self.cfg.alpha
        if not np.isfinite(x).all():
            return pd.Series(x).groupby(series, sort=False).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        begin = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
        lengths = np.diff(np.r_[begin, len(x)])
        out = np.empty(len(x))
        long = lengths > LONG_SERIES
        for at, n in zip(begin[long].tolist(), lengths[long].tolist(), strict=True):
            out[at : at + n] = pd.Series(x[at : at + n]).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        begin, lengths = begin[~long], lengths[~long]
        if not len(begin):
            return out
        longest_first = np.argsort(-lengths, kind="stable")
        at, lengths = begin[longest_first], lengths[longest_first]
        new = 1.0 / (1.0 + (1.0 / alpha - 1.0))  # pandas goes by way of the centre of mass
        old = 1.0 - new
        mean = out[at] = x[at]
        for step in range(1, int(lengths[0])):
            n = int(np.searchsorted(-lengths, -step))  # the series longer than this
            value, mean = x[at[:n] + step], mean[:n]
            mean = np.where(mean != value, (old * mean + new * value) / (old + new), mean)
            out[at[:n] + step] = mean
        return out


class HalfSpaceTrees(Recurrence):
    """Half-space trees (Tan, Ting and Liu, 2011) per device and sensor type.

    Random trees of fixed height cut the unit cube; counts of one window score
    the next. Output is clip(raw + 0.5, 0, 1), so 0.5 during the first window.
    """

    fields = [("isolation_forest", _DOUBLE)]

    def __init__(self, cfg: HalfSpace = HalfSpace(), limits: dict[str, list[tuple[float, float]]] | None = None):
        self.cfg = cfg
        self.limits = limits or {}
        self.forests: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def forest(self, dims: int):
        """Split feature and threshold per (tree, inner node), heap-numbered from 1; fixed by the seed."""
        if dims not in self.forests:
            cfg = self.cfg
            rng = np.random.default_rng(cfg.seed)
            feature = np.zeros((cfg.n_trees, 2**cfg.height), dtype=np.int64)
            threshold = np.zeros((cfg.n_trees, 2**cfg.height))
            for tree in range(cfg.n_trees):
                low, high = {1: np.zeros(dims)}, {1: np.ones(dims)}
                for node in range(1, 2**cfg.height):
                    lo, hi = low.pop(node), high.pop(node)
                    f = rng.choice(dims, p=(hi - lo) / (hi - lo).sum())
                    pad = 0.15 * (hi[f] - lo[f])
                    at = rng.uniform(lo[f] + pad, hi[f] - pad)
                    feature[tree, node], threshold[tree, node] = f, at
                    low[2 * node], high[2 * node] = lo, np.r_[hi[:f], at, hi[f + 1 :]]
                    low[2 * node + 1], high[2 * node + 1] = np.r_[lo[:f], at, lo[f + 1 :]], hi
            self.forests[dims] = (feature, threshold)
        return self.forests[dims]

    def scaled(self, x: np.ndarray, sensor_type: str) -> np.ndarray:
        span = self.limits.get(sensor_type) if self.cfg.limits == "catalog" else None
        if span is None:
            return x
        low, high = np.array(span).T
        return (x - low) / np.maximum(high - low, 1e-12)

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Nodes visited, shape (rows, height + 1, trees)."""
        cfg = self.cfg
        feature, threshold = self.forest(x.shape[1])
        trees = np.arange(cfg.n_trees)
        node = np.ones((len(x), cfg.n_trees), dtype=np.int64)
        out = np.empty((len(x), cfg.height + 1, cfg.n_trees), dtype=np.int64)
        out[:, 0] = node
        for depth in range(1, cfg.height + 1):
            f = feature[trees, node]
            right = np.take_along_axis(x, f, axis=1) >= threshold[trees, node]
            node = 2 * node + right
            out[:, depth] = node
        return out

    def visits(self, paths: np.ndarray) -> np.ndarray:
        """How often each node of each tree is on the paths."""
        nodes = 2 ** (self.cfg.height + 1)
        at = (paths + np.arange(self.cfg.n_trees) * nodes).ravel()
        return np.bincount(at, minlength=self.cfg.n_trees * nodes).reshape(-1, nodes).astype(np.int32)

    def score(self, paths: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """1 - normalised mass; a walk stops after a node lighter than a tenth of the window."""
        cfg = self.cfg
        m = mass[np.arange(cfg.n_trees), paths]
        light = m < 0.1 * cfg.window
        stopped = np.cumsum(light, axis=1) - light > 0
        weight = (2.0 ** np.arange(cfg.height + 1))[None, :, None]
        total = np.where(stopped, 0.0, m * weight).sum(axis=(1, 2))
        return 1.0 - total / (cfg.n_trees * cfg.window * (2 ** (cfg.height + 1) - 1))

    def run(self, batch, first, carry):
        cfg = self.cfg
        shape = (cfg.n_trees, 2 ** (cfg.height + 1))
        out = np.empty(batch.num_rows)
        bounds = run_bounds(first)
        flat, offsets = vectors(batch.column("vector"), bounds)
        kinds = batch.column("sensor_type").to_pylist()
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            x = self.scaled(flat[offsets[lo] : offsets[hi]].reshape(hi - lo, -1), kinds[lo])
            if i == 0 and carry is not None:
                reference, current, filled = carry
                current = current.copy()
            else:
                reference, current, filled = None, np.zeros(shape, np.int32), 0
            path = self.paths(x)
            at = 0
            while at < len(x):
                upto = min(len(x), at + cfg.window - filled)
                part = path[at:upto]
                raw = 0.0 if reference is None else self.score(part, reference)
                out[lo + at : lo + upto] = np.clip(raw + 0.5, 0.0, 1.0)
                current += self.visits(part)
                filled += upto - at
                at = upto
                if filled == cfg.window:
                    reference, current, filled = current, np.zeros(shape, np.int32), 0
        return [pa.array(out)], (reference, current, filled)


class HalfSpaceSlots(HalfSpaceTrees):
    """The same trees over groups of at most two windows: the rows of the window
    before (role 0, sorted first) and the rows to score (role 1)."""

    def run(self, batch, first, carry):
        cfg = self.cfg
        shape = (cfg.n_trees, 2 ** (cfg.height + 1))
        out = np.full(batch.num_rows, np.nan)
        bounds = run_bounds(first)
        flat, offsets = vectors(batch.column("vector"), bounds)
        role = batch.column("role").to_numpy(zero_copy_only=False)
        kinds = batch.column("sensor_type").to_pylist()
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            mass, filled = carry if (i == 0 and carry is not None) else (np.zeros(shape, np.int32), 0)
            path = self.paths(self.scaled(flat[offsets[lo] : offsets[hi]].reshape(hi - lo, -1), kinds[lo]))
            split = int((role[lo:hi] == 0).sum())
            if split:
                mass = mass.copy()
                mass += self.visits(path[:split])
                filled += split
            raw = self.score(path[split:], mass) if filled == cfg.window else 0.0
            out[lo + split : hi] = np.clip(raw + 0.5, 0.0, 1.0)
        return [pa.array(out, mask=np.isnan(out))], (mass, filled)


def vectors(column: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array<double> column, and the offset of each row plus the end.

    All rows of a run get the length of its first row: sensor types outside
    the catalog have no fixed field list, and may report more or fewer fields.
    """
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    want = np.repeat(sizes[bounds[:-1]], np.diff(bounds))
    if (sizes == want).all():
        return values, offsets
    rows = [np.pad(values[o : o + min(n, w)], (0, w - min(n, w))) for o, n, w in zip(offsets, sizes, want)]
    return np.concatenate(rows), np.r_[0, np.cumsum(want)]


def _wavefront(batch, first):
    """Groups runs by vector length, longest run first.

    Yields (dims, run numbers, start rows, lengths): step t of a recurrence can
    then be done at once for all runs longer than t, a prefix of the group.
    """
    bounds = run_bounds(first)
    flat, offsets = vectors(batch.column("vector"), bounds)
    starts, lengths = bounds[:-1], np.diff(bounds)
    dims = (offsets[1:] - offsets[:-1])[starts]
    for d in np.unique(dims):
        runs = np.flatnonzero(dims == d)
        runs = runs[np.argsort(-lengths[runs], kind="stable")]
        yield int(d), runs, starts[runs], lengths[runs], flat, offsets


NORM_ALPHA = 0.05  # fixed value: weight of a new row in the running mean and spread


class _Norm:
    """Running mean and spread per run; rows come out centred, scaled and clipped to +-10."""

    def __init__(self, x0: np.ndarray):
        self.mean = x0.copy()
        self.std = np.ones_like(x0)

    def step(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        mean = (1 - NORM_ALPHA) * self.mean[:n] + NORM_ALPHA * x
        std = (1 - NORM_ALPHA) * self.std[:n] + NORM_ALPHA * (np.abs(x - mean) + 1e-3)
        self.mean[:n], self.std[:n] = mean, std
        return np.clip((x - mean) / std, -10.0, 10.0)


class OnlineAutoencoder(Recurrence):
    """One hidden ReLU layer per device and sensor type, one gradient step per event.

    With `models`, sensor types that have a frozen network are scored by it
    instead; the input normalisation is the same.
    """

    fields = [("autoencoder", _DOUBLE), ("ae_recon_mse", _DOUBLE), ("ae_train_mse", _DOUBLE)]

    def __init__(self, cfg: Autoencoder = Autoencoder(), models: FrozenModels | None = None):
        self.cfg = cfg
        self.models = models

    def run(self, batch, first, carry):
        n = batch.num_rows
        score, recon = np.zeros(n), np.full(n, np.nan)
        train = np.full(n, np.nan)
        states = {}
        kinds = batch.column("sensor_type").to_pylist() if self.models else None
        for dims, runs, starts, lengths, flat, offsets in _wavefront(batch, first):
            frozen = np.array([self.models.has(kinds[s]) for s in starts]) if kinds else np.zeros(len(runs), bool)
            for part, step in ((~frozen, self._online), (frozen, self._frozen)):
                if part.any():
                    args = (dims, runs[part], starts[part], lengths[part], flat, offsets)
                    entry = carry if not first[0] else None
                    with np.errstate(over="ignore", invalid="ignore"):
                        step(args, entry, kinds, score, recon, train, states)
        columns = [
            pa.array(score),
            pa.array(recon, mask=np.isnan(recon)),
            pa.array(train, mask=np.isnan(train)),
        ]
        return columns, states[int(len(run_bounds(first)) - 2)]

    def _online(self, args, entry, kinds, score, recon, train, states):
        cfg = self.cfg
        dims, runs, starts, lengths, flat, offsets = args
        r = len(runs)
        rng = np.random.default_rng(cfg.seed)
        w1 = np.repeat(rng.normal(0, 0.1, (1, dims, cfg.hidden_dim)), r, axis=0)
        w2 = np.repeat(rng.normal(0, 0.1, (1, cfg.hidden_dim, dims)), r, axis=0)
        rows_at = lambda t, k: flat[offsets[starts[:k] + t][:, None] + np.arange(dims)]
        norm = _Norm(rows_at(0, r))
        seen = np.zeros(r, dtype=np.int64)
        ema = np.zeros(r)
        head = np.flatnonzero(runs == 0)
        if entry is not None and len(head):
            i = head[0]
            norm.mean[i], norm.std[i], w1[i], w2[i], seen[i], ema[i] = entry
        for t in range(int(lengths[0])):
            k = int(np.searchsorted(-lengths, -t))
            x = norm.step(rows_at(t, k))
            a1, a2 = w1[:k], w2[:k]
            hidden = np.maximum(np.einsum("rd,rdh->rh", x, a1), 0.0)
            error = np.einsum("rh,rhd->rd", hidden, a2) - x
            mse = (error**2).mean(axis=1)
            grad = 2.0 * error
            back = np.einsum("rd,rhd->rh", grad, a2) * (hidden > 0)
            a2 -= cfg.learning_rate * hidden[:, :, None] * grad[:, None, :]
            a1 -= cfg.learning_rate * x[:, :, None] * back[:, None, :]
            ema[:k] = np.where(seen[:k] == 0, mse, 0.05 * mse + 0.95 * ema[:k])
            seen[:k] += 1
            hidden = np.maximum(np.einsum("rd,rdh->rh", x, a1), 0.0)
            after = ((np.einsum("rh,rhd->rd", hidden, a2) - x) ** 2).mean(axis=1)
            ratio = after / np.maximum(ema[:k], 1e-9)
            ready = seen[:k] >= cfg.min_samples
            at = starts[:k] + t
            scaled = np.clip((ratio - 1.0) / max(cfg.error_threshold, 1e-6), 0.0, 1.0)
            # a diverged network (inf or nan errors) gives no score
            score[at] = np.where(ready & ~np.isnan(scaled), scaled, 0.0)
            recon[at] = after
            train[at] = np.where(ready, mse, np.nan)
        for i, run in enumerate(runs):
            states[int(run)] = (norm.mean[i], norm.std[i], w1[i], w2[i], int(seen[i]), float(ema[i]))

    def _frozen(self, args, entry, kinds, score, recon, train, states):
        dims, runs, starts, lengths, flat, offsets = args
        rows_at = lambda t, k: flat[offsets[starts[:k] + t][:, None] + np.arange(dims)]
        norm = _Norm(rows_at(0, len(runs)))
        head = np.flatnonzero(runs == 0)
        if entry is not None and len(head):
            norm.mean[head[0]], norm.std[head[0]] = entry[0], entry[1]
        total = int(lengths.sum())
        inputs, at = np.empty((total, dims)), np.empty(total, dtype=np.int64)
        done = 0
        for t in range(int(lengths[0])):
            k = int(np.searchsorted(-lengths, -t))
            inputs[done : done + k] = norm.step(rows_at(t, k))
            at[done : done + k] = starts[:k] + t
            done += k
        names = np.array([kinds[row] for row in at], dtype=object)
        for name in sorted(set(names)):
            mine = names == name
            mse = ((inputs[mine] - self.models.apply(name, inputs[mine])) ** 2).mean(axis=1)
            score[at[mine]] = np.minimum(1.0, mse / max(self.cfg.error_threshold, 1e-6))
            recon[at[mine]] = mse
        for i, run in enumerate(runs):
            states[int(run)] = (norm.mean[i], norm.std[i], None, None, 0, 0.0)


class FrozenModels:
    """Trained networks by sensor type; `default` serves the others.

    A model is a list of weight matrices with ReLU in between, or a list of
    (weights, bias) pairs, or the bytes of an ONNX file where onnxruntime is
    installed. Models are small configuration and travel with the task.
    """

    def __init__(self, by_type: dict[str, object], default: object = None):
        self.by_type = by_type
        self.default = default
        self._sessions: dict[int, object] = {}

    def __getstate__(self):
        return {"by_type": self.by_type, "default": self.default, "_sessions": {}}

    def has(self, sensor_type: str) -> bool:
        return self.by_type.get(sensor_type, self.default) is not None

    def apply(self, sensor_type: str, x: np.ndarray) -> np.ndarray:
        model = self.by_type.get(sensor_type, self.default)
        if isinstance(model, bytes):
            return self._onnx(model, x)
        for depth, layer in enumerate(model):
            weights, bias = layer if isinstance(layer, tuple) else (layer, 0.0)
            x = x @ weights + bias
            if depth < len(model) - 1:
                x = np.maximum(x, 0.0)
        return x

    def _onnx(self, model: bytes, x: np.ndarray) -> np.ndarray:
        import onnxruntime

        session = self._sessions.get(id(model))
        if session is None:
            session = self._sessions[id(model)] = onnxruntime.InferenceSession(model)
        first = session.get_inputs()[0]
        x = x.astype(np.float32)
        # a model with a fixed first dimension takes so many rows at a time; others take them all
        step = first.shape[0] if first.shape and isinstance(first.shape[0], int) else len(x)
        short = -len(x) % step if step else 0
        x = np.concatenate([x, np.repeat(x[-1:], short, 0)])
        parts = [session.run(None, {first.name: x[i : i + step]})[0] for i in range(0, len(x), max(step, 1))]
        return np.concatenate(parts)[: len(x) - short] if parts else x


class AdwinDrift(Recurrence):
    """Drift flag per device on the first metric of each event.

    The detector sees every value. Its verdict is read at most once per
    check_interval_seconds of event time; in between the last one stands.
    """

    fields = [("drift_detected", T.BooleanType())]

    def __init__(self, cfg: Drift = Drift(), value: str = "primary", time: str = "timestamp"):
        self.cfg = cfg
        self.value = value
        self.time = time
        self.every = int(cfg.check_interval_seconds * 1_000_000)

    def run(self, batch, first, carry):
        t = micros(batch.column(self.time))
        values = batch.column(self.value).to_numpy(zero_copy_only=False).astype(float)
        seen = batch.column(self.value).is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(batch.num_rows, dtype=bool)
        bounds = run_bounds(first)
        state = carry
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if first[lo] or state is None:
                state = [Adwin(self.cfg.adwin_delta).state(), None, False]
            at = lo + np.flatnonzero(seen[lo:hi])  # an event without metrics is not looked at
            if len(at):
                window = Adwin(self.cfg.adwin_delta, state[0])
                changed = window.extend(values[at])
                out[at], read, verdict = self._verdicts(t[at], changed, state[1], state[2])
                state = [window.state(), read, verdict]
        return [pa.array(out)], state

    def _verdicts(self, t, changed, read, verdict):
        """(the verdict that stands at each event, time of the last reading, its verdict)."""
        if self.every <= 0:
            return changed, int(t[-1]), bool(changed[-1])
        out, at = np.empty(len(t), bool), 0
        while True:
            stands = at if read is None else at + int(np.searchsorted(t[at:], read + self.every))
            out[at:stands] = verdict
            if stands >= len(t):
                return out, read, verdict
            read, verdict, at = int(t[stands]), bool(changed[stands]), stands + 1
            out[stands] = verdict


class Adwin:
    """Adaptive window (Bifet and Gavalda, 2007): an exponential histogram of
    (total, variance sum) buckets, tested for a cut every `clock` values."""

    # fixed values: bucket rows hold up to 5 buckets; cuts are tested every 32
    # values once 10 are in the window, with at least 5 on each side
    MAX_BUCKETS, CLOCK, GRACE, MIN_SIDE = 5, 32, 10, 5

    def __init__(self, delta: float, state=None):
        self.delta = delta
        # rows[i]: buckets of 2**i values, oldest first, as (total, m2)
        self.rows, self.width, self.total, self.m2, self.ticks = state or ([[]], 0, 0.0, 0.0, 0)
        self.rows = [list(r) for r in self.rows]

    def state(self):
        return (self.rows, self.width, self.total, self.m2, self.ticks)

    def add(self, value: float) -> bool:
        return bool(self.extend(np.array([value], dtype=float))[0])

    def extend(self, values: np.ndarray) -> np.ndarray:
        """Takes values in order; true where a test found a change. Values between two tests enter together."""
        changed, at = np.zeros(len(values), bool), 0
        while at < len(values):
            some = values[at : at + self.CLOCK - self.ticks % self.CLOCK]
            self._insert(some)
            at += len(some)
            if self.ticks % self.CLOCK == 0 and self.width > self.GRACE:
                while self._has_cut():
                    changed[at - 1] = True
                    self._drop_oldest()
        return changed

    def _insert(self, v: np.ndarray) -> None:
        n, total = len(v), float(v.sum())
        gap = total / n - (self.total / self.width if self.width else 0.0)
        self.m2 += float(((v - total / n) ** 2).sum()) + gap * gap * self.width * n / (self.width + n)
        self.ticks += n
        self.width += n
        self.total += total
        self.rows[0] += [(x, 0.0) for x in v.tolist()]
        self._merge_full_rows()

    def _merge_full_rows(self):
        """Rows that hold too many buckets merge their oldest in pairs, as many as if each value had come alone."""
        for i, row in enumerate(self.rows):
            pairs = (len(row) - self.MAX_BUCKETS + 1) // 2
            if pairs <= 0:
                return
            if i + 1 == len(self.rows):
                self.rows.append([])
            n = 2**i
            merged = [(t1 + t2, q1 + q2 + (t1 - t2) ** 2 / (2 * n)) for (t1, q1), (t2, q2) in zip(row[0 : 2 * pairs : 2], row[1 : 2 * pairs : 2])]
            del row[: 2 * pairs]
            self.rows[i + 1] += merged

    def _drop_oldest(self):
        top = len(self.rows) - 1
        n = 2**top
        total, m2 = self.rows[top].pop(0)
        if not self.rows[top] and top:
            self.rows.pop()
        rest = self.width - n
        gap = total / n - ((self.total - total) / rest if rest else 0.0)
        self.m2 -= m2 + (n * rest / self.width) * gap * gap
        self.width, self.total = rest, self.total - total

    def _has_cut(self) -> bool:
        """Whether the means on both sides of some bucket border differ too much; all borders at once."""
        if self.width <= 1:
            return False
        sizes = np.repeat(2 ** np.arange(len(self.rows))[::-1], [len(r) for r in self.rows[::-1]])
        totals = np.array([total for row in self.rows[::-1] for total, _ in row])
        n0, sum0 = np.cumsum(sizes), np.cumsum(totals)
        usable = (n0 >= self.MIN_SIDE) & (self.width - n0 >= self.MIN_SIDE)
        n0, sum0 = n0[usable], sum0[usable]
        if not len(n0):
            return False
        n1 = self.width - n0
        spread = 2.0 * max(self.m2, 0.0) / self.width
        confidence = np.log(2.0 * np.log(self.width) / self.delta)
        weight = 1.0 / (n0 - self.MIN_SIDE + 1) + 1.0 / (n1 - self.MIN_SIDE + 1)
        bound = np.sqrt(weight * spread * confidence) + 2.0 / 3.0 * confidence * weight
        return bool((np.abs(sum0 / n0 - (self.total - sum0) / n1) > bound).any())
