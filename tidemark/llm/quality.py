"""Document quality by a regularised quadratic discriminant.

Statistics of a text are transformed so that each class is close to normal.
Class means and covariances come from sums over all labelled rows, one
aggregation; covariances are shrunk towards a scaled identity and kept as
inverse Cholesky factors. The score is the posterior of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import columns, table
from tidemark.llm.text import WORD, Texts, byte_class, from_arrow, word_hashes, words

SLICE = 4 << 20
STATISTICS = "doc_id long, x array<double>"
SUMS = "label int, key int, value double"
SCORES = "doc_id long, score double"
NAMES = ["bytes", "words", "word_length", "lower", "upper", "digit", "space", "newline", "prose_mark", "symbol", "bar", "shout", "non_ascii", "other", "same_as_before", "distinct_words", "repeated_lines"]
LINE = byte_class(b"\n\r")


def _classes() -> np.ndarray:
    c = np.full(256, 10, np.int64)
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"-?()", b"#$%&*@^~_=+<>{}[]\\/`", b"|", b"!"]
    for i, members in enumerate(groups):
        c[list(members)] = i
    c[128:] = 9
    return c


CLASSES = _classes()


def statistics(texts: Texts) -> np.ndarray:
    """One row of transformed statistics for each text; an empty text has zero counts and shares."""
    n = len(texts)
    size = np.diff(texts.offsets)
    counts = np.bincount(np.repeat(np.arange(n), size) * 11 + CLASSES[texts.data], minlength=n * 11).reshape(n, 11)
    w = words(texts, WORD)
    h, n_words = word_hashes(texts, w), w.counts()
    owner = np.repeat(np.arange(n), n_words)
    same = np.zeros(n, np.int64)
    if len(h):
        again = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1
        same = np.bincount(owner[again], minlength=n)
    lines = words(texts, LINE)
    share = lambda a, b: a / np.maximum(b, 1)
    small = lambda x: np.log(x + 0.002)
    columns_ = [np.log1p(size), np.log1p(n_words), share(size - counts[:, 3] - counts[:, 4], n_words)]
    columns_ += [small(share(counts[:, i], size)) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
    columns_ += [small(share(same, n_words)), share(distinct(h, owner, n), n_words), small(1 - share(distinct(word_hashes(texts, lines), np.repeat(np.arange(n), lines.counts()), n), lines.counts()))]
    return np.stack(columns_, 1).astype(np.float64)


def distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n owners."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


@dataclass
class Discriminant:
    """Log density of each class up to a shared constant: offset - |inverse @ (x - mean)|^2 / 2."""

    means: np.ndarray
    inverses: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1."""
        each = [o - 0.5 * (((x - m) @ i.T) ** 2).sum(1) for m, i, o in zip(self.means, self.inverses, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(each[0] - each[1], -500, 500)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of x for each label: (label int, x array<double>) in one aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.stack(batch.column("x").to_numpy(zero_copy_only=False)) if len(label) else np.zeros((0, 0))
            for c in np.unique(label):
                one = np.concatenate([np.ones((int((label == c).sum()), 1)), x[label == c]], 1)
                total[int(c)] = total.get(int(c), 0) + one.T @ one
        for c, sums in total.items():
            yield from columns({"label": np.full(sums.size, c, np.int32), "key": np.arange(sums.size, dtype=np.int32), "value": sums.ravel()}, SUMS).to_batches()

    out: dict[int, dict[int, float]] = {}
    for r in labelled.mapInArrow(run, SUMS).groupBy("label", "key").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r.label, {})[r.key] = r.value
    done = {}
    for c, cells in out.items():
        sums = np.array([cells[k] for k in range(len(cells))]).reshape(int(len(cells) ** 0.5), -1)
        done[c] = sums[0, 0], sums[0, 1:], sums[1:, 1:]
    return done


def fit(labelled: DataFrame, shrinkage: float = 0.1) -> Discriminant | float:
    """The discriminant, or the share of label 1 if a class has fewer than two rows (0.5 without rows)."""
    m = moments(labelled)
    count = {c: m[c][0] if c in m else 0 for c in (0, 1)}
    if min(count.values()) < 2:
        return count[1] / sum(count.values()) if sum(count.values()) else 0.5
    means, inverses, offsets = [], [], []
    for c in (0, 1):
        n, s, p = m[c]
        mean = s / n
        cov = p / n - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / len(mean) * np.eye(len(mean)) + 1e-6 * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        inverses.append(np.linalg.inv(factor))
        offsets.append(np.log(n) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(inverses), np.array(offsets))


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in from_arrow(batch.column("text")).slices(SLICE):
                x = statistics(part)
                arrays = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), arrays], ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, STATISTICS)


def score(docs: DataFrame, model: Discriminant | float) -> DataFrame:
    """Quality of each whole text from 0 to 1. docs: doc_id long, text string; other columns are not read.

    One row for each input row, repeated ids included. A null text counts as empty; an empty text is scored by its
    zero statistics.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in from_arrow(batch.column("text")).slices(SLICE):
                found = np.full(j - i, model) if isinstance(model, float) else model.score(statistics(part))
                yield from table(list(zip(batch.column("doc_id").slice(i, j - i).to_pylist(), found.tolist(), strict=True)), SCORES).to_batches()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, SCORES)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = labels.where("quality IS NOT NULL").where(~held_out).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    model = fit(document_statistics(docs).join(known, "doc_id").select("label", "x"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
