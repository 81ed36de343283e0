"""Long repeats of bytes, found with run-compressed Burrows-Wheeler indexes.

A corpus has no single index, so equal strings are first brought together. Every
LENGTH-byte window gets an anchor that depends on its content alone: among its
sampled K-grams the rarest (by the estimates of a partitioned count-min sketch),
of equals the smallest hash, the rightmost copy. A window with a sampled K-gram
that occurs once cannot repeat and is left out. Neighbouring windows of one
anchor form a context, and contexts are dealt out by anchor: equal windows meet
in one part, and each window is in one context only.

A part holds a repetitive collection. Equal contexts are one text with a
multiplicity. The others that share an anchor are concatenated, the BWT is cut
into runs, and matching lengths are taken at the sampled run ends only: inside a
run the match of the next position is one byte shorter (the irreducible values
of the permuted LCP array), so one pass over the text streams all matching
statistics. A window is a repeat if its context has copies or its match with the
row before or after it reaches LENGTH.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import chunks as C
from tidemark.llm.text import BASES, Texts, covered, mix, prefix, rolling_hash, spans_hash, windows

K, SAMPLE = 32, 16
SLICE = 1 << 20
PART_BYTES = 2 << 20
BATCH = 1 << 20
END = 0xFF  # no byte of UTF-8
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
CONTEXTS = "part int, chunk int, anchors binary, sizes binary, copies binary, blob binary"
ANSWER = "chunk int, shard int, row int, body binary"
RESULT = "doc_id long, text_hash long, copy int, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_text string, kept_sha256 string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position on, over document borders too."""
    if len(data) < K:
        return np.zeros(0, np.uint64)
    return mix(rolling_hash(prefix(data, BASES[0]), K, BASES[0]))


def sampled(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the sampled K-grams inside documents of at least `length` bytes."""
    where, values = [], []
    size = np.diff(texts.offsets)
    for i, j, part in texts.slices(SLICE):
        h = gram_hashes(part.data)
        at = np.flatnonzero((h & np.uint64(SAMPLE - 1)) == 0)
        doc = np.searchsorted(part.offsets, at, "right") - 1
        inside = (at + K <= part.offsets[doc + 1]) & (size[i:j][doc] >= length)
        where.append(at[inside] + texts.offsets[i])
        values.append(mix(h[at[inside]]))
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(where), np.concatenate(values)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[p:p + width] for each p, by running minima of blocks."""
    n = len(values)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, NONE)
    padded[:n] = values
    b = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(b, 1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def with_places(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """At each place the upper half of its value, of equals the rightmost place smallest; NONE elsewhere.

    Half of a value will do: which place is smallest in a window still follows from the window's content alone.
    """
    out = np.full(n, NONE)
    out[at] = (values & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    return out


def contexts(texts: Texts, length: int, where: np.ndarray, values: np.ndarray, estimate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each context, windows as byte positions in texts.data."""
    anchors, firsts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    width = length - K + 1
    order = (estimate.astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
    for i, j, part in texts.slices(SLICE):
        base, n = texts.offsets[i], len(part.data)
        a, b = np.searchsorted(where, [base, texts.offsets[j]])
        at = where[a:b] - base
        start, _ = windows(np.diff(part.offsets), length)
        once = np.zeros(n + 1, np.int64)
        lonely = at[estimate[a:b] < 2]
        once += np.bincount(np.maximum(lonely - width + 1, 0), minlength=n + 1)
        once -= np.bincount(lonely + 1, minlength=n + 1)
        start = start[np.cumsum(once)[start] == 0]
        if not len(start):
            continue
        best = sliding_min(with_places(order[a:b], at, n), width)[start]
        bare = np.flatnonzero(best == NONE)
        keys = np.zeros(n, np.uint64)
        keys[at] = values[a:b]
        place = (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)
        place[bare] = 0
        anchor = keys[place]
        if len(bare):  # no sampled K-gram, as in a run of one character: the smallest of all K-grams
            h = gram_hashes(part.data)
            every = sliding_min(with_places(h, np.arange(len(h)), n), width)[start[bare]]
            place[bare] = (np.uint64(0xFFFFFFFF) - (every & np.uint64(0xFFFFFFFF))).astype(np.int64)
            anchor[bare] = mix(h[place[bare]] ^ np.uint64(BASES[2]))
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1]) | (anchor[1:] != anchor[:-1])
        head = np.flatnonzero(new)
        anchors.append(anchor[head])
        firsts.append(start[head] + base)
        counts.append(np.diff(np.append(head, len(start))))
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(counts)


def distinct_contexts(texts: Texts, length: int, anchor: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Equal contexts as one: (group of each context, a member of each group, size of each group); groups in order of anchor."""
    end = first + count + length - 1
    bytes_ = np.zeros((len(first), 2), np.uint64)
    i = 0
    while i < len(first):  # contexts in order of place, some SLICE bytes at a time
        j = max(i + 1, int(np.searchsorted(end, first[i] + SLICE, "right")))
        data = texts.data[first[i] : end[j - 1]]
        for k, b in enumerate(BASES[:2]):
            bytes_[i:j, k] = mix(spans_hash(prefix(data, b), first[i:j] - first[i], end[i:j] - first[i], b))
        i = j
    keys = np.column_stack([anchor, bytes_, count.astype(np.uint64)])
    order = np.lexsort(keys.T[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(1)
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    head = order[new]
    return group, head, np.bincount(group, minlength=len(head))


def words_at(text: np.ndarray) -> np.ndarray:
    """The next 8 bytes from each position, past the text separators, as one big-endian number."""
    padded = np.concatenate([text, np.full(8, END, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= padded[i : i + len(text)]
    return out


def dense_ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    keys = keys[order]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]), dtype=np.int32)
    return rank


def suffix_array(text: np.ndarray, next8: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling from 8 bytes on.

    The text must end with one separator that has no separator before it.
    """
    n = len(text)
    if n > 1 and (text[-1] != END or text[-2] == END):
        raise ValueError("a text ends with one separator")
    rank, h = dense_ranks(next8), 8
    while int(rank.max()) + 1 < n:
        key = rank * np.int64(n + 2)
        key[: max(0, n - h)] += rank[h:]
        key[max(0, n - h) :] += n + 1  # past the text, as in its padding, separators go on
        rank = dense_ranks(key)
        h *= 2
    rows = np.empty(n, np.int64)
    rows[rank] = np.arange(n)
    return rows


def match_lengths(next8: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bytes from positions a and b on, in steps of 8 bytes; different suffixes, so every comparison ends."""
    n, done, open_ = len(next8), np.zeros(len(a), np.int64), np.arange(len(a))
    while len(open_):
        x, y = a[open_] + done[open_], b[open_] + done[open_]
        inside = (x < n) & (y < n)
        differ = np.full(len(open_), NONE)
        differ[inside] = next8[x[inside]] ^ next8[y[inside]]
        same = np.zeros(len(open_), np.int64)
        for k in range(1, 9):
            same += differ < np.uint64(1 << (64 - 8 * k)) if k < 8 else differ == 0
        done[open_] += same
        open_ = open_[same == 8]
    return done


def repeats(text: np.ndarray, length: int) -> np.ndarray:
    """Positions whose next `length` bytes also start elsewhere in the text, by a run-compressed BWT."""
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    next8 = words_at(text)
    rows = suffix_array(text, next8)
    bwt = np.where(rows > 0, text[rows - 1], 256)  # nothing stands before the text: a symbol of its own
    heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))  # run heads; the rows before them are run ends
    found = np.zeros(n, bool)
    pairs = heads[1:]
    sample = match_lengths(next8, rows[pairs], rows[pairs - 1])
    for at, value, first in ((rows[pairs], sample, rows[0]), (rows[pairs - 1], sample, rows[-1])):
        # streams the text: a position that is no sample matches one byte less than the position before it
        known = np.full(n, -1, np.int64)
        known[at] = value
        known[first] = 0
        last = np.maximum.accumulate(np.where(known >= 0, np.arange(n), -1))
        held = last >= 0
        left = np.zeros(n, np.int64)
        left[held] = known[last[held]] - (np.flatnonzero(held) - last[held])
        found |= left >= length
    return found


def repeated_windows(blob: np.ndarray, start: np.ndarray, anchor: np.ndarray, windows_of: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """Flag of every window of distinct contexts: blob[start:start + windows + length - 1], in order of anchor."""
    flags = np.repeat(copies > 1, windows_of)
    if not len(anchor):
        return flags
    shift = np.cumsum(windows_of) - windows_of
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    size = windows_of + length
    members = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    chosen = np.flatnonzero(members > 1)  # a context alone at its anchor has no other to match
    anchors_at = np.cumsum(new)[chosen]
    i = 0
    while i < len(chosen):
        j = max(i + 1, int(np.searchsorted(np.cumsum(size[chosen[i:]]), BATCH, "right")) + i)
        j = int(np.searchsorted(anchors_at, anchors_at[j - 1], "right"))  # an anchor's contexts stay together
        some = chosen[i:j]
        text = np.full(int(size[some].sum()), END, np.uint8)
        at = np.cumsum(size[some]) - size[some]
        for a, s, w in zip(at.tolist(), start[some].tolist(), windows_of[some].tolist(), strict=True):
            text[a : a + w + length - 1] = blob[s : s + w + length - 1]
        hit = repeats(text, length)
        for a, w, f in zip(at.tolist(), windows_of[some].tolist(), shift[some].tolist(), strict=True):
            flags[f : f + w] |= hit[a : a + w]
        i = j
    return flags


def dedup_spans(docs: DataFrame, length: int = 400, layout: tuple[int, int, int] | None = None) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts anywhere else, in the same document or another.

    docs: doc_id long, text string; other columns are not read. One row for each input row with a doc_id: n_bytes,
    n_removed, n_spans (maximal removed runs), their byte offsets (starts, ends), kept_text (the remaining bytes, without
    characters that lost some of theirs) and the SHA-256 of the remaining bytes; text_hash (xxhash64 of the text, null as
    empty) and copy (0, 1, ... among rows of equal id and text) tell the rows of one id apart. Null and
    empty texts keep the empty text. A text shorter than `length` loses nothing. Repeated rows are copies of each other
    and lose all their windows. An empty table gives no rows.
    """
    if layout is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # a chunk's rolling sums take some 30 bytes for each of its own
        layout = C.chunk_count(4 * total), C.shard_count(total / SAMPLE), 1 << max(4, int(np.ceil(np.log2(max(1, total / PART_BYTES)))))
    chunks, shards, parts = layout
    shift = np.uint64(64 - (parts.bit_length() - 1))
    packed = C.packed(docs, chunks)

    def sketch(chunk: int, ids: np.ndarray, texts: Texts) -> pa.Table:
        return C.table(C.partial_sketch(chunk, sampled(texts, length)[1], shards), C.SENT)

    def gathered(texts: Texts, replies: pa.Table):
        where, values = sampled(texts, length)
        anchor, first, count = contexts(texts, length, where, values, C.estimates(values, replies, shards))
        group, head, copies = distinct_contexts(texts, length, anchor, first, count)
        part = (anchor[head] >> shift).astype(np.int64)
        return anchor, first, count, group, head, copies, np.searchsorted(part, np.arange(parts + 1))

    def send(chunk: int, ids: np.ndarray, texts: Texts, replies: pa.Table) -> pa.Table:
        anchor, first, count, _, head, copies, cuts = gathered(texts, replies)
        data, rows = texts.data.tobytes(), []
        for p in np.flatnonzero(np.diff(cuts)):
            some = head[cuts[p] : cuts[p + 1]]
            blob = b"".join([data[f : f + c + length - 1] for f, c in zip(first[some].tolist(), count[some].tolist(), strict=True)])
            rows.append((p, chunk, anchor[some].tobytes(), C.squeeze(count[some].astype(np.int32)), C.squeeze(np.minimum(copies[cuts[p] : cuts[p + 1]], 2).astype(np.uint8)), zstandard.compress(blob, 1)))
        return C.table(rows, CONTEXTS)

    def index(key, group):
        """Flags of the windows of each chunk's contexts, from the index of the part."""
        chunk = group.column("chunk").to_pylist()
        anchor = [np.frombuffer(x, np.uint64) for x in group.column("anchors").to_pylist()]
        count = [C.expand(x, np.int32).astype(np.int64) for x in group.column("sizes").to_pylist()]
        copies = [C.expand(x, np.uint8) for x in group.column("copies").to_pylist()]
        blobs = [zstandard.decompress(x) for x in group.column("blob").to_pylist()]
        each = [len(x) for x in anchor]
        a, c, m = np.concatenate(anchor), np.concatenate(count), np.concatenate(copies)
        blob = Texts(np.frombuffer(b"".join(blobs), np.uint8), np.zeros(1, np.int64))
        size = c + length - 1
        start = np.cumsum(size) - size
        same, head, _ = distinct_contexts(blob, length, a, start, c)
        flags = repeated_windows(blob.data, start[head], a[head], c[head], np.bincount(same, weights=m), length)
        at = np.cumsum(c[head]) - c[head]
        rows, done = [], 0
        for k, n in zip(chunk, each, strict=True):
            own = same[done : done + n]
            took = np.concatenate([flags[at[g] : at[g] + c[head[g]]] for g in own])
            rows.append((k, key[0].as_py(), C.ROWS, C.squeeze(np.packbits(took))))
            done += n
        return C.table(rows, ANSWER)

    def remove(chunk: int, ids: np.ndarray, texts: Texts, answers: pa.Table) -> pa.Table:
        row = np.array(answers.column("row").to_pylist(), np.int64)
        anchor, first, count, group, head, _, cuts = gathered(texts, answers.filter(pa.array(row < C.ROWS)))
        told = answers.filter(pa.array(row == C.ROWS))
        body = dict(zip(told.column("shard").to_pylist(), told.column("body").to_pylist(), strict=True))
        size = count[head]
        at = np.cumsum(size) - size
        flags = np.zeros(int(size.sum()), bool)
        for p in np.flatnonzero(np.diff(cuts)):
            a, n = at[cuts[p]], int(size[cuts[p] : cuts[p + 1]].sum())
            flags[a : a + n] = np.unpackbits(C.expand(body[p], np.uint8), count=n).astype(bool)
        if len(first):
            offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            gone = (np.repeat(first, count) + offset)[flags[np.repeat(at[group], count) + offset]]
        else:
            gone = np.zeros(0, np.int64)
        return C.table(rebuilt(ids, texts, covered(gone, length, len(texts.data))), RESULT)

    replies = C.merged(C.per_chunk(packed, sketch, C.SENT))
    answers = C.with_replies(packed, replies, send, CONTEXTS).groupBy("part").applyInArrow(index, ANSWER)
    return C.with_replies(packed, replies.unionByName(answers), remove, RESULT)


def rebuilt(ids: np.ndarray, texts: Texts, gone: np.ndarray) -> list[tuple]:
    rows, raw, last, copy = [], texts.data.tobytes(), None, 0
    for d in range(len(ids)):
        a, b = int(texts.offsets[d]), int(texts.offsets[d + 1])
        digest = xxhash.xxh64_intdigest(raw[a:b], seed=42)
        copy = copy + 1 if last == (ids[d], digest) else 0
        last = ids[d], digest
        lost = gone[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
        kept = texts.data[a:b][~lost].tobytes() if len(edge) else raw[a:b]
        rows.append((int(ids[d]), digest - (1 << 64) if digest >> 63 else digest, copy, b - a, int(lost.sum()), len(edge) // 2, edge[::2], edge[1::2], kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest()))
    return rows


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
