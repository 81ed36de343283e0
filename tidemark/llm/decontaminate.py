"""Benchmark decontamination by winnowing.

From every window of WINDOW - K + 1 consecutive K-grams the smallest hash is kept
(the rightmost of equals), for documents and items alike, so each shared span of
WINDOW words leaves at least one fingerprint that both sides keep. Fingerprints
are joined, and each hit is extended to the item's whole windows by comparing
128-bit hashes of all windows of the document with those of the items it met.
Items of fewer words than WINDOW are one window and meet documents by the hash
of that window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import table
from tidemark.llm.text import ALNUM, covered, from_arrow, lower, mix, window_hashes, windows, word_hashes, words

WINDOW, K = 13, 8
SLICE = 2 << 20
FILTER_BITS = 22
ITEM = "item_id string, size int, prints array<long>, keys binary"
FOUND = "doc_id long, n_words long, prints array<long>, text string"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items string"


def winnow(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, document) kept from documents of counts[i] word hashes."""
    grams, owner = windows(counts, K)
    values = window_hashes(hashes, grams, K)
    start, doc = windows(np.bincount(owner, minlength=len(counts)), WINDOW - K + 1)
    best = start.copy()
    for shift in range(1, WINDOW - K + 1):
        best = np.where(values[start + shift] <= values[best], start + shift, best)
    keep = np.unique(best)
    return values[keep], owner[keep]


def short_prints(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    start, doc = windows(counts, size)
    return mix(window_hashes(hashes, start, size) + np.uint64(size)), doc


def both_keys(hashes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return np.stack([window_hashes(hashes, start, size), window_hashes(hashes, start, size, 1)], 1)


def item_prints(benchmark: DataFrame) -> DataFrame:
    """(item_id, size of its windows, fingerprints, window keys) of the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = lower(from_arrow(batch.column("text")))
            w = words(texts, ALNUM)
            h, counts, ids = word_hashes(texts, w), w.counts(), batch.column("item_id").to_pylist()
            rows = []
            for i in np.flatnonzero(counts):
                own, one = h[w.first[i] : w.first[i + 1]], counts[i : i + 1]
                size = min(WINDOW, len(own))
                prints = winnow(own, one)[0] if size == WINDOW else short_prints(own, one, size)[0]
                keys = np.unique(both_keys(own, np.arange(len(own) - size + 1), size), axis=0)
                rows.append((ids[i], size, np.unique(prints).astype(np.int64), keys.tobytes()))
            if rows:
                yield from table(rows, ITEM).to_batches()

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL").mapInArrow(run, ITEM)


def document_prints(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, n_words, fingerprints that pass the filter, and the text if any pass)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = lower(from_arrow(batch.column("text")))
            for i, j, part in texts.slices(SLICE):
                w = words(part, ALNUM)
                h, counts = word_hashes(part, w), w.counts()
                prints, owners = [], []
                for values, doc in [winnow(h, counts), *(short_prints(h, counts, s) for s in sizes)]:
                    at = (values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    passed = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                    prints.append(values[passed])
                    owners.append(doc[passed])
                value, owner = np.concatenate(prints), np.concatenate(owners)
                order = np.lexsort((value, owner))
                value, owner = value[order], owner[order]
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                lists = [np.unique(value[a:b]).astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                text = pa.array([batch.column("text")[i + d].as_py() if len(x) else None for d, x in enumerate(lists)], pa.string())
                ids = batch.column("doc_id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(lists, pa.list_(pa.int64())), text], ["doc_id", "n_words", "prints", "text"])

    return docs.select("doc_id", F.col("text").cast("string")).where("doc_id IS NOT NULL").mapInArrow(run, FOUND)


def extend_hits(found: DataFrame) -> DataFrame:
    """Exact windows: found has doc_id, n_words, text and items, a list of (item_id, size, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, n_words = [], batch.column("doc_id").to_pylist(), batch.column("n_words").to_pylist()
            for row in range(batch.num_rows):
                met = batch.column("items")[row].as_py()
                if not met:
                    rows.append((ids[row], n_words[row], 0, 0, ""))
                    continue
                texts = lower(from_arrow(batch.column("text").slice(row, 1)))
                w = words(texts, ALNUM)
                h, hit, held = word_hashes(texts, w), np.zeros(len(w.start), bool), set()
                for size in {m["size"] for m in met}:
                    own = both_keys(h, np.arange(max(0, len(h) - size + 1)), size).view("u8,u8").ravel()
                    some = [(m["item_id"], np.frombuffer(m["keys"], np.uint64).reshape(-1, 2).view("u8,u8").ravel()) for m in met if m["size"] == size]
                    wanted = np.concatenate([k for _, k in some])
                    at = np.flatnonzero(np.isin(own["f0"], wanted["f0"]))
                    there = set(own[at].tolist()) & set(wanted.tolist())
                    hit |= covered(np.array([a for a, k in zip(at, own[at].tolist(), strict=True) if k in there], np.int64), size, len(h))
                    held |= {name for name, k in some if not there.isdisjoint(k.tolist())}
                rows.append((ids[row], n_words[row], int(hit.sum()), len(held), ",".join(sorted(held))))
            if rows:
                yield from table(rows, RESULT).to_batches()

    return found.mapInArrow(run, RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    docs: doc_id long, text string. benchmark: item_id of any type, text string. Other columns are not read.
    Columns: doc_id, n_words, n_hit, n_items, items (their ids as strings, sorted, comma-joined), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words). Words are runs of ASCII letters and digits and non-ASCII characters,
    A-Z lower-cased. One row for each document row with an id; null, empty and wordless texts have no words and
    no hits; items without words or id count for nothing; an item given twice counts once, and an id given with two
    texts has the windows of both. Without items there
    are no hits; an empty table of documents gives no rows.

    The items' fingerprints fill a bit table of fixed size (2^22 bits), the only thing that is broadcast. It lets
    some others pass and loses none; the join that follows is exact.
    """
    items = item_prints(benchmark)
    slots = F.explode("prints").alias("print")
    shift = 64 - FILTER_BITS
    known = items.select("size", slots).select("size", F.shiftrightunsigned("print", shift).cast("int").alias("slot")).distinct()
    bits, sizes = np.zeros(1 << (FILTER_BITS - 3), np.uint8), set()
    for r in known.toLocalIterator():  # no more rows than bits for each window size
        bits[r.slot >> 3] |= 1 << (r.slot & 7)
        sizes.add(r.size)
    found = document_prints(docs, bits, sorted(sizes - {WINDOW}))
    hits = found.select("doc_id", slots).join(items.select("item_id", slots), "print").select("doc_id", "item_id").distinct()
    held = items.select("item_id", "size", "keys").distinct()  # an id with two texts has the windows of both
    met = hits.join(held, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "size", "keys")).alias("items"))
    return extend_hits(found.select("doc_id", "n_words", "text").join(met, "doc_id", "left")).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")
