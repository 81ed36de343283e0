"""Operators 1, 5 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import chunks as C
from tidemark.llm import jaccard_join, substring_dedup, suffix_dedup
from tidemark.llm.components import components
from tidemark.llm.text import from_arrow, word_hashes, words, WORD

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def brute_windows(rows, size):
    first = {}
    split = [(d, SPACES.findall(t)) for d, t in rows]
    for d, w in sorted(split, key=lambda r: r[0]):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def test_window_dedup_equals_brute_force(docs, with_ids):
    for size in (50, 3):
        got = substring_dedup.dedup_windows(docs, size, layout=(5, 16)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_windows(with_ids, size)
        assert all(sha(r.kept_text) == r.kept_sha256 for r in got)


def test_window_dedup_of_no_documents(no_docs):
    assert substring_dedup.dedup_windows(no_docs).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 5000, 2000)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(4)]
    sent = [r for k, p in enumerate(parts) for r in C.partial_sketch(k, p, 16)]
    import pyarrow as pa

    replies = []
    for key in {(r[0], r[1]) for r in sent}:
        group = C.table([r for r in sent if (r[0], r[1]) == key], C.SENT)
        replies.append(C.merge_shard((pa.scalar(int(key[0])), pa.scalar(int(key[1]))), group))
    told = pa.concat_tables(replies)
    true = Counter(x for p in parts for x in p.tolist())
    for k, p in enumerate(parts):
        own = told.filter(pa.compute.equal(told.column("chunk"), k))
        assert all(e >= true[x] for e, x in zip(C.estimates(p, own, 16).tolist(), p.tolist(), strict=True))


def test_words_split_at_ascii_space_only():
    import pyarrow as pa

    texts = from_arrow(pa.array(["a b c\x85d", None, "", " x\x0b"]))
    w = words(texts, WORD)
    assert w.counts().tolist() == [2, 0, 0, 1] and len(set(word_hashes(texts, w).tolist())) == 3


def brute_components(rows, size=5):
    sets = {}
    for d, t in rows:
        w = SPACES.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets[d] = grams
    of = {d: d for d in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard_components_equal_brute_force(docs, with_ids):
    got = jaccard_join.jaccard_components(docs, layout=(5, 16)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(with_ids)
    assert len(got) == len(with_ids)


def test_jaccard_finds_links_of_frequent_tokens(spark, monkeypatch):
    """A group of near copies larger than the rare class, chained by edits, and short texts."""
    monkeypatch.setattr(jaccard_join, "RARE", 3)
    r = random.Random(11)
    base, rows = [f"w{i}" for i in range(60)], []
    for d in range(120):
        if d % 10 == 0:
            base = [f"w{r.randrange(500)}" if r.random() < 0.15 else w for w in base]
        words_ = list(base[: r.choice([60, 60, 57, 30, 7, 4])])
        words_[r.randrange(len(words_))] = "z"
        rows.append((d, " ".join(words_)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(df, layout=(4, 16)).collect()}
    assert got == brute_components(rows)


def test_jaccard_meets_a_pair_in_one_bucket(spark, monkeypatch):
    """Sets that share many frequent tokens and are not similar come out of few of their common buckets; all links are found."""
    monkeypatch.setattr(jaccard_join, "RARE", 3)
    r, met = random.Random(12), []
    ordered = jaccard_join.ordered

    def counted(pairs):
        met.append((pairs.count(), pairs.select("b", pairs.columns[0]).distinct().count()))
        return ordered(pairs)

    passages, rows = [" ".join(f"p{i}_{k}" for k in range(8)) for i in range(24)], []
    for d in range(90):
        words_ = [p for i, p in enumerate(passages) if r.random() < 0.8]
        rows.append((d, " ".join(words_)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "ordered", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(df, layout=(4, 16)).collect()}
    assert got == brute_components(rows)
    rounds = met[1:]  # after the pivots
    assert sum(n for _, n in rounds) > 0
    assert sum(n for n, _ in rounds) < 4 * sum(n for _, n in rounds)


def test_jaccard_of_no_documents(no_docs):
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)} | {199: 199, 200: 199}


def brute_bytes(rows, length):
    data = [(d, t.encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append((d, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def test_span_dedup_equals_brute_force(docs, with_ids):
    for length in (400, 60):
        got = suffix_dedup.dedup_spans(docs, length, layout=(5, 16, 16)).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(with_ids, length)
        assert all(sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed for r in got)


def test_span_dedup_of_no_documents(no_docs):
    assert suffix_dedup.dedup_spans(no_docs).count() == 0


def test_run_length_index_equals_brute_force():
    r = random.Random(5)
    for _ in range(400):
        letters = r.choice([1, 2, 3])
        parts = [bytes(r.randrange(97, 97 + letters) for _ in range(r.randrange(1, 40))) for _ in range(3)]
        x = b"".join(r.choice(parts) + (b"\xff" if r.random() < 0.3 else b"") for _ in range(r.randrange(1, 12))).rstrip(b"\xff") + b"\xff"
        n = r.randrange(2, 20)
        seen = Counter(x[i : i + n] for i in range(len(x) - n + 1))
        whole = np.array([i + n <= len(x) and b"\xff" not in x[i : i + n] for i in range(len(x))])
        want = np.array([w and seen[x[i : i + n]] > 1 for i, w in enumerate(whole)])
        assert ((suffix_dedup.repeats(np.frombuffer(x, np.uint8), n) & whole) == want).all()
