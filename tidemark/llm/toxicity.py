"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents, so token labels are derived: a word of a toxic
document is toxic if it, or one of its beginnings, is far more frequent in toxic
than in other documents of the labelled sample. A two-state field over evidence
levels of a word and its neighbours is trained on them; forward-backward
marginals give every word a probability. Their sum, without background below
FLOOR, is an expected number of toxic words and becomes the document's score by a fitted logistic, and words above one
half are reported with their byte offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import table
from tidemark.llm.sampling import by_hash
from tidemark.llm.text import ALNUM, BASES, Texts, Words, from_arrow, lower, mix, prefix, spans_hash, words

SLICE = 2 << 20
BEGINNINGS = (4, 5, 6, 7)  # bytes
LEVELS = np.log(np.array([2.0, 4.0, 8.0, 16.0, 32.0, 64.0]))
TAGGED = np.log(16.0)
CELLS = 1 << 19
FLOOR = 0.1
GRAMS = "toxic int, gram long"
SCORES = "doc_id long, score double, expected double, n_spans int, starts array<long>, ends array<long>"


def grams(texts: Texts, w: Words) -> list[np.ndarray]:
    """Hashes of every word and of its beginnings; a word shorter than a beginning counts as that beginning."""
    sums = prefix(texts.data, BASES[0])
    cut = [w.end, *(np.minimum(w.end, w.start + n) for n in BEGINNINGS)]
    return [mix(spans_hash(sums, w.start, e, BASES[0]) + np.uint64(i * 0x9E3779B9)) for i, e in enumerate(cut)]


@dataclass
class Evidence:
    """Log odds of grams, sorted by gram, behind a bit table."""

    keys: np.ndarray
    odds: np.ndarray

    def __post_init__(self):
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def of(self, texts: Texts, w: Words) -> np.ndarray:
        """The largest log odds among a word's grams, at least 0."""
        best = np.zeros(len(w.start))
        if not len(self.keys):
            return best
        for g in grams(texts, w):
            at = np.flatnonzero(self.table[(g >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            hit = self.keys[k] == g[at]
            best[at[hit]] = np.maximum(best[at[hit]], self.odds[k[hit]])
        return best


def features(odds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word, which weights apply: of its own level and of its neighbours' levels inside the document."""
    level = np.searchsorted(LEVELS, odds, "right")
    n = len(LEVELS) + 1
    before, after = np.zeros(len(level), np.int64), np.zeros(len(level), np.int64)
    before[1:], after[:-1] = level[:-1], level[1:]
    first = np.cumsum(counts) - counts
    before[first[counts > 0]] = 0
    after[(first + counts - 1)[counts > 0]] = 0
    return np.stack([level, n + before, 2 * n + after], 1)


N_FEATURES = 3 * (len(LEVELS) + 1)


@dataclass
class Chain:
    """Two states, 0 and 1. weights score state 1 against 0; moves[i, j] scores going from i to j."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, f: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of state 1 for every word of documents of counts[i] words, by forward-backward."""
        out = np.zeros(len(f))
        emit = self.weights[f].sum(1)
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        i = 0
        while i < len(order):
            rows = order[i : i + max(1, CELLS // int(counts[order[i]]))]
            at = np.minimum(first[rows][:, None] + np.arange(counts[rows[0]]), len(f) - 1)
            real = np.arange(counts[rows[0]]) < counts[rows][:, None]
            out[at[real]] = forward_backward(emit[at], real, self.moves)[0][real]
            i += len(rows)
        return out


def forward_backward(emit: np.ndarray, real: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """(probability of state 1 at each step, expected moves, log partition) of padded sequences, rows by steps."""
    n, steps = emit.shape
    score = np.exp(np.clip(emit, -30, 30))
    m = np.exp(moves)
    ahead, scale = np.zeros((steps, n, 2)), np.zeros((steps, n))
    a = np.ones((n, 2))
    for t in range(steps):
        a = a @ m if t else a
        a = np.stack([a[:, 0], a[:, 1] * score[:, t]], 1)
        a = np.where(real[:, t, None], a, ahead[t - 1] if t else a)
        s = a.sum(1)
        scale[t] = np.where(real[:, t], np.log(s), 0)
        a = a / s[:, None]
        ahead[t] = a
    back = np.ones((steps, n, 2))
    b = np.ones((n, 2))
    moved = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        e = np.stack([b[:, 0], b[:, 1] * score[:, t + 1]], 1)
        if pairs:
            joint = ahead[t][:, :, None] * m[None] * e[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            moved += (joint * real[:, t + 1, None, None]).sum(0)
        b = np.where(real[:, t + 1, None], e @ m.T, 1.0)
        b = b / b.sum(1, keepdims=True)
        back[t] = b
    both = ahead * back
    return (both[:, :, 1] / both.sum(2)).T, moved, float(scale.sum())


def train_chain(f: np.ndarray, tags: np.ndarray, real: np.ndarray, steps: int = 150, ridge: float = 1e-6) -> Chain:
    """Adam on the penalised likelihood of sequences of equal padded length: f (rows, steps, features), tags, real."""
    weights, moves = np.zeros(N_FEATURES), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    both = real[:, 1:] & real[:, :-1]
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((tags[:, :-1] == a) & (tags[:, 1:] == b) & both).sum()
    observed = np.bincount(f[real & (tags == 1)].ravel(), minlength=N_FEATURES)
    size, mean, square = max(1, int(real.sum())), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for k in range(1, steps + 1):
        p, moved, _ = forward_backward(weights[f].sum(2), real, moves, pairs=True)
        expected = np.zeros(N_FEATURES)
        for j in range(f.shape[2]):
            expected += np.bincount(f[:, :, j][real], weights=p[real], minlength=N_FEATURES)
        g = np.concatenate([observed - expected, (seen - moved).ravel()]) / size - ridge * np.concatenate([weights, moves.ravel()])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = 0.3 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        weights, moves = weights + step[:N_FEATURES], moves + step[N_FEATURES:].reshape(2, 2)
    return Chain(weights, moves)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(intercept, slope) of P(y = 1) by Newton's method, weighted so that both classes count as in y."""
    w, x1 = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        w = w + np.linalg.solve((x1.T * (p * (1 - p))) @ x1 + ridge * np.eye(2), x1.T @ (y - p) - ridge * w)
    return float(w[0]), float(w[1])


@dataclass
class Tagger:
    evidence: Evidence
    chain: Chain
    intercept: float
    slope: float

    def marginals(self, texts: Texts) -> tuple[Words, np.ndarray]:
        w = words(texts, ALNUM)
        counts = w.counts()
        return w, self.chain.marginals(features(self.evidence.of(texts, w), counts), counts)

    def score(self, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(expected), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, lexicon: int = 20_000, fold: int = 600) -> Tagger:
    """Train on a bounded sample: of each label the `per_class` documents with the smallest hashes of doc_id.

    labels: doc_id, toxic (0 or 1); nulls are left out. Gram counts come from the whole sample in one aggregation,
    of which the `lexicon` grams with the largest log odds return to the driver; the field is
    trained on `fold` documents of each class, or on half of fewer, and the logistic on as many others. The share of label 1
    is of all labels, not of the sample. Without labels of both classes all scores are that share.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few, of_all = by_hash(known, "toxic", per_class)
    labelled = of_all.get(0, 0) + of_all.get(1, 0)
    share = of_all.get(1, 0) / labelled if labelled else 0.5
    some = F.broadcast(few)  # at most 2 * per_class ids: a proven bound
    sample = docs.select("doc_id", F.col("text").cast("string")).join(some, "doc_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = lower(from_arrow(batch.column("text")))
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            for i, j, part in texts.slices(SLICE):
                w = words(part, ALNUM)
                owner = np.repeat(np.arange(j - i), w.counts())
                for g in grams(part, w):
                    pairs = np.unique(np.stack([owner.astype(np.uint64), g], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(label[i + pairs[:, 0].astype(np.int64)], pa.int32()), pa.array(pairs[:, 1].view(np.int64))], ["toxic", "gram"])

    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        odds = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Tagger(Evidence(np.zeros(0, np.uint64), np.zeros(0)), Chain(np.zeros(N_FEATURES), np.zeros((2, 2))), float(odds), 0.0)
    n, rest = F.sum("toxic"), F.count("*") - F.sum("toxic")
    # less one standard error: rare grams are weak evidence
    odds = F.log((n + 0.5) / (n1 + 1)) - F.log((rest + 0.5) / (n0 + 1)) - F.sqrt(1 / (n + 0.5) + 1 / (rest + 0.5))
    found = sample.mapInArrow(each, GRAMS).groupBy("gram").agg(odds.alias("odds"), F.sum("toxic").alias("n")).where((F.col("n") >= 3) & (F.col("odds") >= float(LEVELS[0])))
    rows = found.orderBy(F.desc("odds"), "gram").limit(lexicon).collect()
    keys, values = np.array([r.gram for r in rows], np.int64).view(np.uint64), np.array([r.odds for r in rows])
    order = np.argsort(keys)
    evidence = Evidence(keys[order], values[order])
    return finish(evidence, sample.where(F.col("rank") <= 2 * fold), share)


def finish(evidence: Evidence, sample: DataFrame, share: float, size: int = 64) -> Tagger:
    """Train the field on pieces of `size` words of every other document of the sample, the logistic on the rest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in lower(from_arrow(batch.column("text"))).slices(SLICE):
                w = words(part, ALNUM)
                odds = evidence.of(part, w)
                cut = [odds[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), batch.column("rank").slice(i, j - i), pa.array(cut, pa.list_(pa.float64()))], ["toxic", "rank", "odds"])

    rows = sample.select("text", "toxic", "rank").mapInArrow(each, "toxic int, rank int, odds array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.toxic, r.rank, len(r.odds)))
    pieces, tags = [], []
    for r in rows:
        if r.rank % 2 and r.odds:
            odds = np.array(r.odds)
            f, t = features(odds, np.array([len(odds)])), (odds >= TAGGED) & bool(r.toxic)
            pieces += [f[i : i + size] for i in range(0, len(f), size)]
            tags += [t[i : i + size].astype(np.int64) for i in range(0, len(f), size)]
    if not pieces:
        return Tagger(evidence, Chain(np.zeros(N_FEATURES), np.zeros((2, 2))), 0.0, 0.0)
    real = np.arange(size) < np.array([len(t) for t in tags])[:, None]
    f, t = np.zeros((len(tags), size, 3), np.int64), np.zeros((len(tags), size), np.int64)
    f[real], t[real] = np.concatenate(pieces), np.concatenate(tags)
    chain = train_chain(f, t, real)
    rest = [r for r in rows if r.rank % 2 == 0]
    rest = rest if len({r.toxic for r in rest}) == 2 else rows
    expected = []
    for r in rest:
        odds, one = np.array(r.odds), np.array([len(r.odds)])
        p = chain.marginals(features(odds, one), one)
        expected.append(p[p >= FLOOR].sum())
    x, y = np.log1p(np.array(expected)), np.array([float(r.toxic) for r in rest])
    intercept, slope = logistic(x, y)
    drawn = y.mean()
    if 0 < drawn < 1 and 0 < share < 1:  # the sample is balanced by class, documents are not
        intercept += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Tagger(evidence, chain, float(intercept), slope)


def tag(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Toxicity of each whole text. docs: doc_id long, text string; other columns are not read.

    One row for each input row, repeated ids included. score from 0 to 1, expected number of toxic words, and the
    maximal runs of words with a marginal of one half or more as byte offsets (starts, ends) of the UTF-8 text.
    Null and wordless texts have no spans and the score of zero expected words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in lower(from_arrow(batch.column("text"))).slices(SLICE):
                w, p = tagger.marginals(part)
                owner = np.repeat(np.arange(j - i), w.counts())
                expected = np.bincount(owner, weights=np.where(p < FLOOR, 0, p), minlength=j - i)
                bad = np.concatenate([[False], p >= 0.5, [False]])
                owner_ = np.concatenate([[-1], owner, [-1]])
                begins = np.flatnonzero(bad[1:-1] & ~(bad[:-2] & (owner_[:-2] == owner)))
                ends = np.flatnonzero(bad[1:-1] & ~(bad[2:] & (owner_[2:] == owner)))
                cuts = np.searchsorted(owner[begins], np.arange(j - i + 1)) if len(begins) else np.zeros(j - i + 1, np.int64)
                base = part.offsets
                rows = []
                for d, (doc, s, e) in enumerate(zip(batch.column("doc_id").slice(i, j - i).to_pylist(), tagger.score(expected).tolist(), expected.tolist(), strict=True)):
                    a, b = cuts[d], cuts[d + 1]
                    rows.append((doc, s, e, int(b - a), w.start[begins[a:b]] - base[d], w.end[ends[a:b]] - base[d]))
                yield from table(rows, SCORES).to_batches()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, SCORES)


def reject(docs: DataFrame, tagger: Tagger, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold. Rows without doc_id are judged too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, j, part in lower(from_arrow(batch.column("text"))).slices(SLICE):
                w, p = tagger.marginals(part)
                owner = np.repeat(np.arange(j - i), w.counts())
                expected = np.bincount(owner, weights=np.where(p < FLOOR, 0, p), minlength=j - i)
                keep.append(tagger.score(expected) < threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def learned(spark, sf_dir: str) -> tuple[Tagger, Column]:
    """The tagger of the labelled rows outside the held-out fold, and that fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return fit(docs, labels.where(~held_out)), held_out


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tagger, held_out = learned(spark, sf_dir)
    return tag(docs, tagger).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "expected", "n_spans")
