"""Substring deduplication of word windows with a count-min prefilter.

1. Each chunk counts its windows in a partial sketch; the merged sketch
   overestimates how often each window occurs.
2. Windows estimated at two or more go, with their smallest doc_id in the chunk,
   to an exact grouping by a 96-bit fingerprint. A window that occurs elsewhere is
   never underestimated, so none is lost.
3. The grouping tells each chunk in one bit per window whether a smaller doc_id
   outside the chunk holds it too; the chunk then removes the covered words.

Everything is one lazy plan: texts cross the network once, compressed, and the
chunks meet the answers by that same exchange. A window held by a third of all
documents counts once per chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import chunks as C
from tidemark.llm.text import WORD, Texts, covered, window_hashes, windows, word_hashes, words

SLICE = 2 << 20
CANDIDATES = "part int, chunk int, keys binary, tags binary, docs binary"
ANSWER = "chunk int, shard int, row int, body binary"
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_text string, kept_sha256 string"


def window_keys(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, further 32 bits, document) of every window, in document order."""
    keys, tags, docs = [], [], []
    for i, _, part in texts.slices(SLICE):
        w = words(part, WORD)
        start, doc = windows(w.counts(), size)
        if len(start):
            h = word_hashes(part, w)
            keys.append(window_hashes(h, start, size))
            tags.append((window_hashes(h, start, size, 1) >> np.uint64(32)).astype(np.uint32))
            docs.append(doc + i)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(tags), np.concatenate(docs)


def chunk_candidates(ids, keys, tags, docs, estimate):
    """Windows estimated at two or more: (positions among all, distinct order, group of each, smallest id of each group)."""
    at = np.flatnonzero(estimate >= 2)
    k, t = keys[at], tags[at]
    order = np.lexsort((t, k))
    k, t, owner = k[order], t[order], ids[docs[at[order]]]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    heads = np.flatnonzero(new)
    smallest = np.minimum.reduceat(owner, heads) if len(heads) else owner
    return at[order], np.cumsum(new) - 1, k[heads], t[heads], smallest


def dedup_windows(docs: DataFrame, size: int = 50, layout: tuple[int, int] | None = None) -> DataFrame:
    """Remove each word covered by a window of `size` words that also starts in a document with a smaller doc_id.

    docs: doc_id long, text string, other columns are not read. One row for each input row with a doc_id:
    n_words, n_removed, n_spans (removed runs), kept_text (kept words joined by one space) and its SHA-256.
    A null or empty text has no words and keeps the empty text. A text of fewer than `size` words has no window.
    Rows that repeat a doc_id are judged against smaller ids only. An empty table gives no rows.
    """
    chunks, shards = layout or C.sizes(docs)
    packed = C.packed(docs, chunks)

    def sketch(chunk: int, ids: np.ndarray, texts: Texts) -> pa.Table:
        return C.table(C.partial_sketch(chunk, window_keys(texts, size)[0], shards), C.SENT)

    bits = np.uint64(64 - (shards.bit_length() - 1))

    def candidates(chunk: int, ids: np.ndarray, texts: Texts, replies: pa.Table) -> pa.Table:
        keys, tags, owners = window_keys(texts, size)
        _, _, k, t, smallest = chunk_candidates(ids, keys, tags, owners, C.estimates(keys, replies, shards))
        part = (k >> bits).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(shards + 1))
        rows = [(p, chunk, k[a:b].tobytes(), t[a:b].tobytes(), C.squeeze(smallest[a:b])) for p in np.unique(part) for a, b in [(cuts[p], cuts[p + 1])]]
        return C.table(rows, CANDIDATES)

    def exact(key, group):
        """One bit for each chunk and window: a smaller doc_id than the chunk's smallest holds it."""
        each = [(np.frombuffer(group.column("keys")[i].as_py(), np.uint64), np.frombuffer(group.column("tags")[i].as_py(), np.uint32), C.expand(group.column("docs")[i].as_py(), np.int64)) for i in range(group.num_rows)]
        k, t, d = (np.concatenate(x) for x in zip(*each, strict=True))
        order = np.lexsort((d, t, k))
        ks, ts = k[order], t[order]
        new = np.ones(len(k), bool)
        new[1:] = (ks[1:] != ks[:-1]) | (ts[1:] != ts[:-1])
        first = d[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        smaller = np.zeros(len(k), bool)
        smaller[order] = first < d[order]
        cuts = np.cumsum([len(x[0]) for x in each])[:-1]
        part = key[0].as_py()
        return C.table([(c, part, C.ROWS, np.packbits(x).tobytes()) for c, x in zip(group.column("chunk").to_pylist(), np.split(smaller, cuts), strict=True)], ANSWER)

    def remove(chunk: int, ids: np.ndarray, texts: Texts, answers: pa.Table) -> pa.Table:
        keys, tags, owners = window_keys(texts, size)
        row = np.array(answers.column("row").to_pylist(), np.int64)
        at, group, k, _, smallest = chunk_candidates(ids, keys, tags, owners, C.estimates(keys, answers.filter(pa.array(row < C.ROWS)), shards))
        part = (k >> bits).astype(np.int64)
        counts = np.bincount(part, minlength=shards) if len(part) else np.zeros(shards, np.int64)
        told = answers.filter(pa.array(row == C.ROWS))
        elsewhere = np.zeros(len(k), bool)
        first = np.cumsum(counts) - counts
        for s, body in zip(told.column("shard").to_pylist(), told.column("body").to_pylist(), strict=True):
            elsewhere[first[s] : first[s] + counts[s]] = np.unpackbits(np.frombuffer(body, np.uint8), count=int(counts[s])).astype(bool)
        gone = np.zeros(len(keys), bool)
        if len(at):
            gone[at] = elsewhere[group] | (ids[owners[at]] > smallest[group])
        return C.table(rebuilt(ids, texts, size, gone), RESULT)

    replies = C.merged(C.per_chunk(packed, sketch, C.SENT))
    sent = C.with_replies(packed, replies, candidates, CANDIDATES)
    answers = sent.groupBy("part").applyInArrow(exact, ANSWER)
    return C.with_replies(packed, replies.unionByName(answers), remove, RESULT)


def rebuilt(ids: np.ndarray, texts: Texts, size: int, gone: np.ndarray) -> list[tuple]:
    """Result rows, given for every window in document order whether its words go."""
    rows, done = [], 0
    for i, j, part in texts.slices(SLICE):
        w = words(part, WORD)
        start, _ = windows(w.counts(), size)
        out = covered(start[gone[done : done + len(start)]], size, len(w.start))
        done += len(start)
        raw = part.data.tobytes()
        for d in range(j - i):
            a, b = int(w.first[d]), int(w.first[d + 1])
            lost = out[a:b]
            if lost.any():
                kept = b" ".join([raw[s:e] for s, e in zip(w.start[a:b][~lost].tolist(), w.end[a:b][~lost].tolist(), strict=True)])
            else:
                kept = b" ".join(raw[part.offsets[d] : part.offsets[d + 1]].split())
            runs = int(np.count_nonzero(np.diff(np.concatenate([[False], lost]).astype(np.int8)) == 1))
            rows.append((int(ids[i + d]), b - a, int(lost.sum()), runs, kept.decode(), hashlib.sha256(kept).hexdigest()))
    return rows


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("n_spans"))
