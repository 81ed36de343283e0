"""Operators 11 to 13 against brute force and exact round trips."""

import glob
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import fill_in_middle, prefix_trie, warc_archive
from tidemark.session import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# fill in middle


def brute_cut(doc_id, text):
    units, at = [], 0
    while at < len(text):
        m = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+").match(text, at)
        units.append(m.group())
        at = m.end()
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    r = random.Random(1)
    some = ["", None, " ", "\n\t", "a", " a ", "é\x85 \x1cb  日本 😀", "x <P> y", "<S", "a<M>", "< S>< P>", "<" * 30 + " S> " * 9, "\x00 \x00"]
    some += ["".join(r.choice("ab \n\t<>SPMé") for _ in range(r.randrange(1, 80))) for _ in range(150)]
    return some


def test_every_cut_equals_a_loop_and_is_undone(spark):
    rows = [(i, t, "x", 1, None) for i, t in enumerate(odd_texts())] + [(7, "one two", "x", 1, None), (7, "one two", "x", 1, None), (None, "a b c d", "x", 1, None), (-5, "a b c", "x", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n long, output string").repartition(3)
    got = fill_in_middle.restore(fill_in_middle.transform(df)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    want = sorted([(i, *brute_cut(i, t or ""), t or "") for i, t, *_ in rows], key=key)
    assert sorted([tuple(r) for r in got], key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_long_texts_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "FLUSH", 10)
    texts = [(i, "word " * n) for i, n in enumerate([1, 60_000, 2, 3, 120_000])]
    monkeypatch.setattr(fill_in_middle, "cut", fill_in_middle.cut)
    got = {r.doc_id: r for r in fill_in_middle.restore(fill_in_middle.transform(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))).collect()}
    for i, t in texts:
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == brute_cut(i, t)
        assert got[i].text == t


def test_cuts_of_no_documents(no_docs):
    assert fill_in_middle.transform(no_docs).count() == 0


# WARC


def odd_pages():
    long, other = "<p>é</p>" * 30, "<p>日本</p>" * 40
    return [
        (5, "http://a", long), (3, "http://b", long), (9, None, long), (None, "http://c", long), (3, "http://b", long),
        (1, "http://d", None), (2, "http://e", ""), (4, "http://f", "short"), (6, "http://g", "short"),
        (7, "http://h\r\nWARC-Type: revisit\r\nx", other + "\r\n\r\nWARC/1.1\r\n"), (8, "", other + "\r\n\r\nWARC/1.1\r\n"),
        (None, "http://i", "y" * 100), (None, "http://j", "y" * 100), (10, "http://k", "z" * 99), (11, "http://k", "z" * 99),
        (-4, "http://l", "w" * 100), (12, "http://l", "w" * 100),
    ]


def brute_records(pages):
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        again = len(body) >= 100 and bool(ids) and page != min(ids)
        out.append((page, len(body), sha(body), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


def parsed(data: bytes):
    """Records of a WARC file by their lengths: (headers, block)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        head = dict(line.split(": ", 1) for line in rest)
        start = end + 4
        at = start + int(head["Content-Length"])
        yield head, data[start:at]
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4


@pytest.fixture()
def pages(spark):
    rows = [(*p, "x", 1, None, "no") for p in odd_pages()]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, slot int, payload string, head string").repartition(3)


def test_archive_gives_back_every_record(spark, pages, monkeypatch):
    for slots in (4096, 2):
        monkeypatch.setattr(warc_archive, "RECORDS_PER_SLOT", slots)
        path = scratch(spark, "warc-test")
        warc_archive.write_archive(pages, path)
        got = warc_archive.read_archive(spark, path)
        rows = got.collect()
        told = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
        assert sorted(told, key=str) == brute_records(odd_pages())
        assert all(sha(bytes(r.payload)) == r.payload_digest for r in rows)
        stored = spark.read.parquet(f"{path}/payloads")
        assert stored.count() == len({h or "" for _, _, h in odd_pages()})
        out = scratch(spark, "warc-files")
        warc_archive.export_warc(spark, path, out)
        files = glob.glob(f"{out.removeprefix('file:')}/part-*")
        records = [x for f in files for x in parsed(open(f, "rb").read())]
        assert len(records) == len(rows)
        by_type = {t: sorted(sha(b.split(b"\r\n\r\n", 1)[1]) for h, b in records if h["WARC-Type"] == t) for t in ("response", "revisit")}
        assert by_type["response"] == sorted(r.payload_digest for r in rows if r.record_type == "response")
        assert set(by_type["revisit"]) == {sha(b"")}
        for h, b in records:
            assert b.startswith(b"HTTP/1.1 200 OK\r\n") and h["WARC-Payload-Digest"].startswith("sha256:")
            assert ("WARC-Refers-To" in h) == (h["WARC-Type"] == "revisit")


def test_archive_finds_broken_and_lost_payloads(spark, pages):
    path = scratch(spark, "warc-test")
    warc_archive.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads").cache()
    stored.count()
    for bad in (stored.selectExpr("digest", "cast('x' as binary) payload", "payload_bytes", "first_id", "records"), stored.where("records > 2")):
        twin = scratch(spark, "warc-test")
        bad.write.parquet(f"{twin}/payloads")
        spark.read.parquet(f"{path}/heads").write.parquet(f"{twin}/heads")
        with pytest.raises(Exception, match="broken payload|no payload"):
            warc_archive.read_archive(spark, twin).select("payload_digest").collect()
        with pytest.raises(Exception, match="broken payload|no payload"):
            warc_archive.read_archive(spark, twin).select("record").collect()
    stored.unpersist()


def test_archive_of_no_pages(spark, pages):
    path = scratch(spark, "warc-test")
    warc_archive.write_archive(pages.limit(0), path)
    assert warc_archive.read_archive(spark, path).count() == 0


# prefix trie


def brute_trie(turns):
    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    convs = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    nodes = sorted(members, key=len, reverse=True)
    kids = {n: 0 for n in nodes}
    leaves, saved = {}, {}
    for n in nodes:
        weight = (len(members[n]) - 1) * len(WORD.findall(n[-1][1])) if n else 0
        leaves[n] = leaves.get(n, 0) or 1
        saved[n] = saved.get(n, 0) + weight
        if n:
            up = n[:-1]
            kids[up] += 1
            leaves[up] = leaves.get(up, 0) + leaves[n]
            saved[up] = saved.get(up, 0) + saved[n]
    out = []
    for n in nodes:
        ends = ",".join(str(c) for c in sorted(members[n]) if len(built[c]) == len(n))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), kids[n], leaves[n], saved[n], sha(ends)))
    return sorted(out, key=str)


def odd_turns():
    r = random.Random(3)
    say = ["hi", "hello there", "tell me more", "", None, "a b  c", "é 日本"]
    out = [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(say)) for c in range(-25, 65) if c % 7 for t in range(r.randrange(1, 7))]
    out += [(100, t, "user", f"long {t % 3}") for t in range(60)] + [(101, t, "user", f"long {t % 3}") for t in range(60)]  # one path, long
    out += [(c, t, "user", "the same") for c in range(200, 260) for t in range(3)]  # a large group of copies
    out += [(300, None, "user", "first"), (300, 0, "user", "second"), (300, 0, "user", "second"), (300, 0, "user", "also second"), (None, 0, "user", "nobody")]
    out += [(3, 0, "user", "only turn"), (400 + 3, 0, "user", "cut away")]
    return out


@pytest.mark.parametrize("limit", [None, 7])
def test_trie_equals_brute_force(spark, monkeypatch, limit):
    if limit:  # every distributed step on little data
        monkeypatch.setattr(prefix_trie, "BLOCK", 8)
        monkeypatch.setattr(prefix_trie, "SLOT", 5)
    turns = odd_turns()
    df = spark.createDataFrame([(*t, 1, "x", 2) for t in turns], "conv_id long, turn long, role string, text string, depth int, k1 string, size int").repartition(3)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df, limit).collect()]
    assert sorted(got, key=str) == brute_trie(turns)


def test_trie_of_no_conversations(spark):
    none = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0
    assert prefix_trie.prefix_trie(none.limit(0)).count() == 0


def test_components_are_rolled_up_on_arrays():
    r = random.Random(4)
    for shape in ("random", "path", "star"):
        n = 400
        parent = [-1] + [{"random": r.randrange(i), "path": i - 1, "star": 0}[shape] for i in range(1, n)]
        parent[n // 2] = -1  # two components
        top = [i if p < 0 else 0 for i, p in enumerate(parent)]
        value = [r.randrange(9) for _ in range(n)]
        size, total = [1] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                size[parent[i]] += size[i]
                total[parent[i]] += total[i] + value[i]
                top[i] = -1
        for i in range(n):
            if parent[i] >= 0:
                top[i] = top[parent[i]]
        at = list(range(n))
        r.shuffle(at)
        new = {old: k for k, old in enumerate(at)}
        got = prefix_trie.split_components(np.array([new.get(parent[o], -1) for o in at]), np.array([new[top[o]] for o in at]), np.array([size[o] for o in at]), np.array([[value[o]] for o in at]))
        assert got[:, 0].tolist() == [total[o] for o in at]
