"""Documents dealt out in chunks, and a count-min sketch that is itself partitioned.

`packed` deals documents by a hash of doc_id into chunks of bounded size, texts
compressed; the one exchange on `chunk` serves every later step of a plan.

`partial_sketch` counts the features of one chunk. A sketch row is cut into
`shards`, and a partial sketch sends each shard only the cells it touched, so
neither the size of a sketch nor a broadcast bounds the input: the number of
shards grows with it. `merged` adds the partial sketches of a shard and answers
each chunk with the merged counts of just its own cells; a feature's estimate is
the smallest of its cells, which never falls short of its true count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Texts, from_arrow, mix

CHUNK_BYTES = 16 << 20
SHARD_FEATURES = 1 << 20
CELL_BITS = 23
ROWS = 2
ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
PACKED = "chunk int, ids binary, sizes binary, blob binary"
SENT = "shard int, row int, chunk int, body binary, counts binary"
REPLY = "chunk int, shard int, row int, body binary"


def squeeze(a: np.ndarray) -> bytes:
    """Byte planes, compressed: bytes that are mostly zero cost next to nothing."""
    width = a.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def expand(body: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(body), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def sizes(docs: DataFrame, pieces: int = 1) -> tuple[int, int]:
    """(chunks, shards) for the bytes of all texts: the one figure that fixes the layout, from one aggregation.

    pieces: how many chunks take the place of one, where a chunk's own arrays are large."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return chunk_count(pieces * total), shard_count(total / 6)


def chunk_count(total: float) -> int:
    return max(64, -(-int(total) // CHUNK_BYTES))


def shard_count(features: float) -> int:
    return 1 << max(4, int(np.ceil(np.log2(max(1.0, features / SHARD_FEATURES)))))


def packed(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, ids, sizes, blob): rows of compressed documents. A row without doc_id is left out; a null text is empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            texts = from_arrow(batch.column("text"))
            chunk = (mix(ids.astype(np.uint64)) % np.uint64(chunks)).astype(np.int32)
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            length, at, data = np.diff(texts.offsets), texts.offsets, texts.data.tobytes()
            rows = []
            for members in np.split(order, cuts[1:]):
                blob = b"".join(data[at[i] : at[i + 1]] for i in members)
                rows.append((chunk[members[0]], ids[members].tobytes(), length[members].tobytes(), zstandard.compress(blob, 1)))
            yield table(rows, PACKED).to_batches()[0]

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(pack, PACKED)


ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def table(rows: list[tuple], schema: str) -> pa.Table:
    """An Arrow table from row tuples."""
    return columns(dict(zip([f.split()[0] for f in schema.split(", ")], zip(*rows) if rows else [[]] * len(schema.split(", ")), strict=True)), schema)


def columns(named: dict, schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(named[n] if isinstance(named[n], np.ndarray) else list(named[n]), ARROW[t]) for n, t in fields})


def unpack(group: pa.Table) -> tuple[np.ndarray, Texts]:
    """(ids, texts) of a chunk, in order of id; rows of one id in order of text."""
    ids, size, blobs = [], [], []
    for i in range(group.num_rows):
        ids.append(np.frombuffer(group.column("ids")[i].as_py(), np.int64))
        size.append(np.frombuffer(group.column("sizes")[i].as_py(), np.int64))
        blobs.append(zstandard.decompress(group.column("blob")[i].as_py(), max_output_size=max(1, int(size[-1].sum()))))
    if not ids:
        return np.zeros(0, np.int64), Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    ids, size, blob = np.concatenate(ids), np.concatenate(size), b"".join(blobs)
    at = np.concatenate([[0], np.cumsum(size)])
    texts = [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    return ids[order], Texts(data, np.concatenate([[0], np.cumsum(size[order])]))


def cell_keys(features: np.ndarray, shards: int, row: int) -> np.ndarray:
    """Shard and cell of each feature in one row of the sketch, as one number."""
    bits = shards.bit_length() - 1
    cell = (features * np.uint64(ODD[row])) >> np.uint64(64 - CELL_BITS)
    return ((features >> np.uint64(64 - bits)) << np.uint64(CELL_BITS)) | cell


def partial_sketch(chunk: int, features: np.ndarray, shards: int) -> list[tuple]:
    """SENT rows: for each row of the sketch and shard, the touched cells in order and their counts up to 255."""
    rows = []
    for row in range(ROWS):
        keys, counts = np.unique(cell_keys(features, shards, row), return_counts=True)
        shard = (keys >> np.uint64(CELL_BITS)).astype(np.int64)
        cells = (keys & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.unique(shard):
            a, b = cuts[s], cuts[s + 1]
            body = squeeze(np.diff(cells[a:b], prepend=np.uint32(0)))
            rows.append((s, row, chunk, body, squeeze(np.minimum(counts[a:b], 255).astype(np.uint8))))
    return rows


def merge_shard(key, group):
    """Adds the partial sketches of a shard; the reply of each chunk is the merged counts (up to 255) of its cells."""
    total = np.zeros(1 << CELL_BITS, np.uint32)
    sent = []
    for i in range(group.num_rows):
        cells = np.cumsum(expand(group.column("body")[i].as_py(), np.uint32))
        total[cells] += expand(group.column("counts")[i].as_py(), np.uint8)
        sent.append(cells)
    chunk = group.column("chunk").to_pylist()
    shard, row = key[0].as_py(), key[1].as_py()
    return table([(c, shard, row, squeeze(np.minimum(total[x], 255).astype(np.uint8))) for c, x in zip(chunk, sent, strict=True)], REPLY)


def merged(sent: DataFrame) -> DataFrame:
    return sent.groupBy("shard", "row").applyInArrow(merge_shard, REPLY)


def estimates(features: np.ndarray, replies: pa.Table, shards: int) -> np.ndarray:
    """Estimated count (up to 255) of each feature of a chunk, from the replies to that chunk's partial sketch."""
    best = np.full(len(features), 255, np.uint8)
    if not len(features):
        return best
    at = sorted(zip(replies.column("row").to_pylist(), replies.column("shard").to_pylist(), range(replies.num_rows), strict=True))
    for row in range(ROWS):
        keys = cell_keys(features, shards, row)
        unique, back = np.unique(keys, return_inverse=True)
        counts = np.concatenate([expand(replies.column("body")[i].as_py(), np.uint8) for r, _, i in at if r == row])
        np.minimum(best, counts[back], out=best)
        del unique
    return best


def per_chunk(packed_docs: DataFrame, fn: Callable[[int, np.ndarray, Texts], pa.Table], schema: str) -> DataFrame:
    def run(key, group):
        return fn(key[0].as_py(), *unpack(group))

    return packed_docs.groupBy("chunk").applyInArrow(run, schema)


def with_replies(packed_docs: DataFrame, replies: DataFrame, fn: Callable[[int, np.ndarray, Texts, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(key, group, answer):
        return fn(key[0].as_py(), *unpack(group), answer)

    return packed_docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)
