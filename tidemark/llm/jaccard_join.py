"""Exact Jaccard join of shingle sets with token-combination prefixes.

Tokens (shingles) are ordered from rare to frequent by the estimates of a
partitioned count-min sketch, ties by hash. Two sets that reach the threshold
share most of the rare end of either, so a document indexes only a prefix:
tokens estimated once count towards it but cannot meet anything and are not
indexed; rare tokens are indexed singly; tokens of the frequent class are put in
groups by hash and indexed as pairs inside a group. A group of c tokens keeps at
least c - 1 - lost of them usable, so the prefix is extended until its singles
plus (c - 1) of each group outnumber the tokens that a similar set may lack.
Then every pair that reaches the threshold shares a single or a pair (the
argument of a prefix filter, with each loss taking away at most one).

Documents that share an index entry form a bucket. A large bucket is not expanded
into all pairs: its members are verified against one pivot; then, in rounds, those
outside the bucket's largest component against a share of the other components' members
that grows sixteenfold each round, so only what is not connected is compared further,
and only rows of buckets that are still open are read again. Two sets that meet in many
buckets are compared in the smallest and, where their buckets differ, in few others.
Bitmaps of token parity bound how many tokens two sets
share and rule out most of these pairs; what is left is compared exactly.
Equal sets are one vertex from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import chunks as C
from tidemark.llm.components import components
from tidemark.llm.text import BASES, WORD, Texts, lower, mix, prefix, spans_hash, window_hashes, windows, word_hashes, words
from tidemark.session import checkpointed, scratch

SHINGLE, NEED, OF = 5, 75, 100
RARE = 32
SLICE = 2 << 20
SETS = "doc_id long, chunk int, n int, k1 long, k2 long"
INDEXED = "doc_id long, n int, s int, entries array<long>, body binary, bits array<long>"
BITMAP = 16  # longs
BEFORE = 8  # open buckets of its set that a row knows


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): document i has the distinct hashes[first[i]:first[i + 1]], in order. A hash has 48 bits, the upper ones."""
    all_hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j, part in texts.slices(SLICE):
        part = lower(part)
        w = words(part, WORD)
        h, n = word_hashes(part, w), w.counts()
        start, doc = windows(n, size)
        values = window_hashes(h, start, size)
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            sums = prefix(h, BASES[1])
            whole = mix(spans_hash(sums, w.first[short], w.first[short + 1], BASES[1]) + n[short].astype(np.uint64) * np.uint64(BASES[0]))
            values, doc = np.concatenate([values, whole]), np.concatenate([doc, short])
        for a in range(0, j - i, 1 << 16):  # documents at a time, so that one number holds document and hash
            some = (doc >= a) & (doc < a + (1 << 16)) if j - i > 1 << 16 else slice(None)
            packed = np.sort(((doc[some] - a).astype(np.uint64) << np.uint64(48)) | (values[some] >> np.uint64(16)))
            packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
            all_hashes.append(packed << np.uint64(16))
            counts.append(np.bincount((packed >> np.uint64(48)).astype(np.int64), minlength=min(1 << 16, j - i - a)))
    return np.concatenate(all_hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def lacking(n):
    """Tokens that a set of n may lack in a similar one: n - ceil(n * NEED / OF)."""
    return n - -(-n * NEED // OF)


def group_counts(n: int) -> list[int]:
    """Numbers of groups for frequent tokens: one for each power of two between the sizes a similar set can have."""
    least, most = -(-n * NEED // OF), n * OF // NEED
    return sorted({max(1, (1 << (k.bit_length() - 1)) // 16) for k in (least, n, most)})


def entries(hashes: np.ndarray, estimate: np.ndarray) -> np.ndarray:
    """Index entries of one set: singles and pairs of its extended prefix."""
    order = np.lexsort((hashes, estimate))
    h, e = hashes[order], estimate[order]
    need, rare = lacking(len(h)) + 1, int(np.searchsorted(e, RARE, "right"))
    if need <= rare:
        return h[:need][e[:need] > 1]
    out, frequent = [h[:rare][e[:rare] > 1]], h[rare:]
    for groups in group_counts(len(h)):
        g = ((frequent >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
        opens = np.zeros(len(g), bool)
        opens[np.unique(g, return_index=True)[1]] = True
        usable = np.arange(1, len(g) + 1) - np.cumsum(opens)
        last = int(np.searchsorted(usable, need - rare)) + 1
        by = np.argsort(g[:last], kind="stable")
        x, y = frequent[:last][by], g[:last][by]
        for lag in range(1, len(x)):
            same = y[lag:] == y[:-lag]
            if not same.any():
                break
            out.append(mix(x[:-lag][same] * np.uint64(BASES[1]) + mix(x[lag:][same] + np.uint64(groups))))
    return np.concatenate(out)


def set_key(hashes: np.ndarray, first: np.ndarray, base: int) -> np.ndarray:
    """One number for each whole set."""
    return mix(spans_hash(prefix(hashes, base), first[:-1], first[1:], base) + np.diff(first).astype(np.uint64)).view(np.int64)


def pack_set(hashes: np.ndarray) -> bytes:
    """The top 48 bits of sorted hashes, as steps."""
    return C.squeeze(np.diff(hashes >> np.uint64(16), prepend=np.uint64(0)))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each of 64 * BITMAP bits: where two differ, the sets differ in a token at least."""
    on = np.bincount((hashes >> np.uint64(16)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) % 2
    return np.packbits(on.astype(np.uint8)).view(np.int64)


def similar_sets(texts_packed: DataFrame, reps: DataFrame, shards: int, size: int) -> DataFrame:
    """INDEXED rows of the representatives that have index entries: entries, s tokens not estimated once, and the set."""
    wide = [F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("doc_id", "k1")]
    told = reps.select("chunk", F.lit(0).alias("shard"), F.lit(C.ROWS).alias("row"), F.concat(*wide).alias("body"))

    def chosen(ids: np.ndarray, texts: Texts, answers: pa.Table):
        rows = np.array(answers.column("row").to_pylist(), np.int64)
        wanted = b"".join(answers.filter(pa.array(rows == C.ROWS)).column("body").to_pylist())
        wanted = np.frombuffer(wanted, ">i8").reshape(-1, 2).astype(np.int64)
        at = np.flatnonzero(np.isin(ids, wanted[:, 0]))
        ids, texts = ids[at], texts.take(at)
        h, first = shingle_sets(texts, size)
        n, keep = np.diff(first), np.ones(len(ids), bool)
        if len(np.unique(ids)) < len(ids):  # one text of each id and set
            pairs = set(map(tuple, wanted.tolist()))
            for i, pair in enumerate(zip(ids.tolist(), set_key(h, first, BASES[0]).tolist(), strict=True)):
                keep[i] = pair in pairs
                pairs.discard(pair)
        return ids[keep], h[np.repeat(keep, n)], n[keep], answers.filter(pa.array(rows < C.ROWS))

    def sketch(chunk: int, ids: np.ndarray, texts: Texts, answers: pa.Table) -> pa.Table:
        return C.table(C.partial_sketch(chunk, chosen(ids, texts, answers)[1], shards), C.SENT)

    def index(chunk: int, ids: np.ndarray, texts: Texts, answers: pa.Table) -> pa.Table:
        ids, h, n, replies = chosen(ids, texts, answers)
        e = C.estimates(h, replies, shards)
        first = np.concatenate([[0], np.cumsum(n)])
        alone = np.concatenate([[0], np.cumsum(e == 1)])
        alone = alone[first[1:]] - alone[first[:-1]]
        rows = []
        for d in np.flatnonzero((n > 0) & (alone <= lacking(n))):
            a, b = first[d], first[d + 1]
            found = entries(h[a:b], e[a:b])
            if len(found):
                rows.append((int(ids[d]), int(n[d]), int(n[d] - alone[d]), found.view(np.int64), pack_set(h[a:b]), bitmap(h[a:b])))
        return C.table(rows, INDEXED)

    replies = C.merged(C.with_replies(texts_packed, told, sketch, C.SENT))
    return C.with_replies(texts_packed, replies.unionByName(told), index, INDEXED)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: each row carries both sets, no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.cumsum(C.expand(z.as_py(), np.uint64)) for z in (x, y))
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(OF * both >= NEED * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("body").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("body").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def can_reach(n, s, n_b, s_b):
    """|x & y| >= NEED / (NEED + OF) * (|x| + |y|), where tokens seen once cannot be shared, and sizes are close."""
    shared = F.least(s, s_b) * (NEED + OF) >= (n + n_b) * NEED
    return shared & (F.least(n, n_b) * OF >= F.greatest(n, n_b) * NEED)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()


def with_first(index: DataFrame, buckets: DataFrame) -> DataFrame:
    """Distinct pairs of every member of a bucket with the bucket's pivot."""
    p = F.col("pivot")
    rows = index.join(buckets, "entry").where(F.col("doc_id") != p.doc_id)
    rows = rows.where(can_reach(F.col("n"), F.col("s"), p.n, p.s))
    return ordered(rows.select("doc_id", p.doc_id.alias("b")))


def with_more(rows: DataFrame, bits: DataFrame, share: float) -> DataFrame:
    """Distinct pairs of members outside the bucket's largest component with members of other components whose own hash
    lies below share / size of the bucket. Of two members in different components one is outside the largest.

    rows: index rows of the open buckets with their component c and the bucket's m and main. Two sets that meet in many
    buckets are compared in the smallest of them, which is through no later than the others: a row knows the open buckets
    of its set just before its own, smallest first, and two rows that both know of one have met there."""
    # texts of one doc_id are told apart by size; repartitioned by doc_id alone, as the join with bits needs it
    before = Window.partitionBy("doc_id", "n", "s").orderBy("m", "entry").rowsBetween(-BEFORE, -1)
    rows = rows.repartition("doc_id").withColumn("before", F.collect_list("entry").over(before)).join(bits, "doc_id")
    outside = rows.where(F.col("c") != F.col("main"))
    others = rows.where(F.col("u") * F.col("m") < share)
    others = others.select("entry", *(F.col(x).alias(f"{y}") for x, y in (("doc_id", "b"), ("n", "n_b"), ("s", "s_b"), ("c", "c_b"), ("bits", "bits_b"), ("before", "before_b"))))
    reach = can_reach(F.col("l.n"), F.col("l.s"), F.col("r.n_b"), F.col("r.s_b"))
    # tokens in one set only are at least the bits that differ, and at most (OF - NEED) / (OF + NEED) of all
    apart = sum((F.bit_count(F.col("l.bits")[i].bitwiseXOR(F.col("r.bits_b")[i])) for i in range(BITMAP)), F.lit(0))
    reach &= apart * (OF + NEED) <= (F.col("l.n") + F.col("r.n_b")) * (OF - NEED)
    reach &= ~F.arrays_overlap("l.before", "r.before_b")
    met = outside.alias("l").join(others.alias("r"), (F.col("l.entry") == F.col("r.entry")) & (F.col("l.c") != F.col("r.c_b")) & reach)
    return ordered(met.select("l.doc_id", "r.b"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a Parquet table, so that they are made once."""
    path = scratch(df.sparkSession, f"jaccard-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, layout: tuple[int, int] | None = None) -> DataFrame:
    """Components of documents whose shingle sets reach a Jaccard similarity of 0.75.

    docs: doc_id long, text string; other columns are not read. Words are lower-cased in A-Z; a set holds the distinct
    `size`-word shingles, or the whole sequence of fewer words as one. Columns: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links, itself included), n_class (documents with exactly this set). One row for each
    input row with a doc_id; rows that repeat a doc_id with other text stand for that id too. Null, empty and wordless
    texts have an empty set and are linked with nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    chunks, shards = layout or C.sizes(docs, pieces=2)
    packed = C.packed(docs, chunks)

    def sets_of(chunk: int, ids: np.ndarray, texts: Texts) -> pa.Table:
        h, first = shingle_sets(texts, size)
        keys = [set_key(h, first, b) for b in BASES[:2]]
        return C.columns({"doc_id": ids, "chunk": np.full(len(ids), chunk, np.int32), "n": np.diff(first).astype(np.int32), "k1": keys[0], "k2": keys[1]}, SETS)

    sets = C.per_chunk(packed, sets_of, SETS)
    classes = sets.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "chunk")).alias("rep"), F.count("*").alias("n_class"))
    reps = classes.where("rep.doc_id IS NOT NULL").select("rep.chunk", "rep.doc_id", "k1")
    path = scratch(spark, "jaccard-index")
    similar_sets(packed, reps, shards, size).write.parquet(path)
    indexed = spark.read.parquet(path)
    u = (F.xxhash64("doc_id").bitwiseAND((1 << 53) - 1) / float(1 << 53)).alias("u")
    index = indexed.select("doc_id", "n", "s", u, F.explode("entries").alias("entry"))
    links, component = links_of(index, indexed)
    table = sets.join(classes, ["k1", "k2"], "left")
    rep = F.coalesce("rep.doc_id", "doc_id")
    table = table.select("doc_id", F.col("n").cast("long").alias("n_shingles"), rep.alias("id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))
    if component is None:
        return table.withColumnRenamed("id", "component_id")
    return table.join(component, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"), "n_class")


def links_of(index: DataFrame, indexed: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(verified links between representatives that span their components, components) or nothing if none links."""
    sets, bits = indexed.select("doc_id", "body"), indexed.select("doc_id", "bits")
    first = F.min(F.struct("u", "doc_id", "n", "s")).alias("pivot")
    buckets = index.groupBy("entry").agg(F.count("*").alias("m"), first).where("m > 1")
    found = written(verified(with_first(index, buckets), sets), "links")
    links, component, share = None, None, 0.0
    while True:
        if found.take(1):
            links = found if links is None else links.unionByName(found)
            component = checkpointed(components(links))
        members = index.withColumn("c", F.col("doc_id"))
        if component is not None:
            members = index.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
        # a bucket whose members are all connected, or were all compared, is done
        shares = members.groupBy("entry", "c").agg(F.count("*").alias("k"))
        left = shares.groupBy("entry").agg(F.sum("k").alias("m"), F.count("*").alias("parts"), F.max(F.struct("k", "c"))["c"].alias("main"))
        buckets = left.where((F.col("parts") > 1) & (F.col("m") > share)).select("entry", "m", "main")
        rows = written(members.join(buckets, "entry").select("doc_id", "n", "s", "u", "entry", "c", "m", "main"), "open")
        if not rows.take(1):
            return links, component
        index = rows.select("doc_id", "n", "s", "u", "entry")  # what is done stays done
        share = float(RARE) if share == 0.0 else share * 16
        found = written(verified(with_more(rows, bits, share), sets), "links")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id", "n_class")
