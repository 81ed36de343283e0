"""Operators 4, 6, 7, 8 and 10: brute force, held-out accuracy and exact round trips."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb

from tidemark.llm import decontaminate, language_id, quality, toxicity
from tidemark.llm.piece_codec import DIGESTS, TOKENS, CharMap, Codec, encode_documents, read_model

from .conftest import LONG, sentence

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a\x00b", "▁x", "x ▁ y", "<s> a</s>", "\t\t x", "日本𝄞 é", "a  ", "<unk>", "  " * 37 + "x", LONG]


def test_codec_equals_the_library(docs, with_ids):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs, MODEL, DIGESTS).collect())
    want = []
    for d, t in [*with_ids, (-1, LONG)]:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert rows == sorted(want)
    assert {r.doc_id for r in encode_documents(docs, MODEL, TOKENS).where("NOT round_trip").collect()} == set()


def test_codec_spans_and_decoding():
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), Codec(read_model(MODEL))
    for t in ODD:
        ids, starts, ends, decoded = codec.encode(t)
        pieces = lib.encode(t, return_type="proto").pieces
        assert [(p.begin, p.end) for p in pieces] == list(zip(starts.tolist()[1:-1], ends.tolist()[1:-1]))
        assert codec.decode(ids.tolist()) == lib.decode(ids.tolist()) == decoded.decode()
    for ids in ([1, 258, 68, 2], [1, 230, 132, 300, 2], [243, 162, 155, 131], [0, 300], []):
        assert codec.decode(ids) == lib.decode(ids)


def charsmap(entries: dict[bytes, bytes]) -> bytes:
    """A compiled character map: a double array made by trying offsets, and its strings."""
    strings, values = b"", {}
    for k, v in entries.items():
        values[k] = len(strings)
        strings += v + b"\0"
    units, used = {0: 0}, {0}

    def place(node: int, prefix: bytes) -> None:
        labels = sorted({k[len(prefix)] if len(k) > len(prefix) else 0 for k in entries if k.startswith(prefix)})
        offset = next(o for o in range(1, 1 << 20) if not used & {node ^ o ^ c for c in labels} and all(node ^ o ^ c for c in labels))
        units[node] |= offset << 10 | (256 if 0 in labels else 0)
        used.update(node ^ offset ^ c for c in labels)
        for c in labels:
            units[node ^ offset ^ c] = c if c else values[prefix] | 1 << 31
        for c in labels:
            if c:
                place(node ^ offset ^ c, prefix + bytes([c]))

    place(0, b"")
    size = (max(units) | 255) + 1
    array = np.zeros(size, "<u4")
    for i, u in units.items():
        array[i] = u
    return (size * 4).to_bytes(4, "little") + array.tobytes() + strings


def test_compiled_map_is_applied_by_longest_prefix_with_alignment():
    entries = {"ﬁ".encode(): b"fi", "①".encode(): b"1", b"ab": b"x", b"abc": b"yz", "　".encode(): b" ", b"\t": b" "}
    blob = charsmap(entries)
    assert CharMap(blob).longest(b"abcd", 0) == (3, b"yz") and CharMap(blob).longest(b"abd", 0) == (2, b"x")
    assert CharMap(blob).longest(b"zab", 0) is None and CharMap(b"").longest(b"ab", 0) is None
    for trim in (False, True):
        proto = model_pb.ModelProto.FromString(read_model(MODEL))
        proto.normalizer_spec.precompiled_charsmap = blob
        proto.normalizer_spec.remove_extra_whitespaces = trim
        raw = proto.SerializeToString()
        lib, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), Codec(raw)
        for t in ["ﬁne ①abc ab", "abcabd　x", "plain text", "日abc", " \t ab  c ", "ab", "a\tb\t\tc"]:
            ids, starts, ends, _ = codec.encode(t)
            assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True)
            assert t.encode()[starts[1] : ends[-2]].strip() == t.encode().strip() or trim
            assert (np.diff(ends[:-1]) >= 0).all() and (starts <= ends).all()


def brute_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, held = find(text), set()
    hit = [0] * len(w)
    for item, t in items:
        v = find(t)
        n = min(13, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                held.add(str(item))
                hit[i : i + n] = [1] * n
    return len(w), sum(hit), len(held), ",".join(sorted(held)), sum(hit) > 0 and 20 * sum(hit) >= len(w)


def test_contamination_equals_brute_force(spark, docs, with_ids):
    w = LONG.split()
    items = [(1, " ".join(w[30:60]).upper()), (2, " ".join(w[100:113])), (3, "two words"), (4, ""), (5, None), (6, "same " * 20), (10, "same"), (11, sentence(99, 30)), (7, " ".join(w[5:17])), (7, " ".join(w[5:17])), (None, LONG)]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontaminate.contamination(docs, table).collect())
    known = [i for i in items if i[0] is not None]
    assert got == sorted((d, *brute_hits(t, known)) for d, t in with_ids)


def test_contamination_of_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination(no_docs, none).count() == 0


def test_language_of_held_out_documents(small_corpus):
    docs = small_corpus("sf0.01", "documents")
    train = docs.where("crc32(cast(doc_id AS string)) % 4 <> 2")
    samples = language_id.sample(train, 200, 500)
    got = {r.doc_id: r for r in language_id.identify(docs, samples).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_of_odd_texts(spark, docs, no_docs):
    samples = {"a": "the cat and the dog " * 40, "b": "der hund und die katze " * 40}
    got = {r.doc_id: r for r in language_id.identify(docs, samples).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {5, 6, 7}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].rejected
    one = spark.createDataFrame([(1, "12 34 !!"), (2, "die katze und der hund")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(one, samples).orderBy("doc_id").collect()] == ["und", "b"]
    assert {r.lang_pred for r in language_id.identify(one, {}).collect()} == {"und"}
    assert language_id.sample(no_docs, 5, 10) == {} and language_id.identify(no_docs, samples).count() == 0


def held_out_accuracy(op, label, small_corpus, spark):
    rows = op(spark, "/root/testdata/sf0.01").collect()
    true = {r.doc_id: r[label] for r in small_corpus("sf0.01", "labels").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in true]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == true[r.doc_id] for r in held) / len(held)


def test_quality_of_held_out_documents(small_corpus, spark):
    assert held_out_accuracy(quality.op7_quality, "quality", small_corpus, spark) >= 0.95


def test_quality_of_odd_texts(docs, no_docs, spark):
    x = spark.createDataFrame([(k % 2, [float(k % 2 + k % 3), float(k % 5)]) for k in range(40)], "label int, x array<double>")
    m = quality.fit(x)
    assert m.score(np.array([[2.0, 2.0]]))[0] > m.score(np.array([[0.0, 2.0]]))[0]
    assert quality.fit(x.where("label = 1")) == 1.0 and quality.fit(x.limit(0)) == 0.5
    got = quality.score(docs, 0.5).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    assert quality.score(no_docs, 0.5).count() == 0


def test_toxicity_of_held_out_documents(small_corpus, spark):
    assert held_out_accuracy(toxicity.op8_toxicity, "toxic", small_corpus, spark) >= 0.93


@pytest.fixture(scope="module")
def tagger(spark):
    rows = [(d, sentence(d, 30) + (" idiot stupid" if d % 3 == 0 else ""), int(d % 3 == 0)) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))


def test_toxic_spans_and_odd_texts(spark, docs, no_docs, tagger):
    one = spark.createDataFrame([(1, "é you stupid IDIOT, really"), (2, "a fine day")], "doc_id long, text string")
    a, b = toxicity.tag(one, tagger).orderBy("doc_id").collect()
    assert a.score > 0.5 > b.score and a.starts == [7] and a.ends[0] >= 19 and b.n_spans == 0
    assert toxicity.tag(docs, tagger).count() == docs.count() and toxicity.tag(no_docs, tagger).count() == 0
    kept = toxicity.reject(docs, tagger)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    empty = toxicity.fit(no_docs, no_docs.select("doc_id", no_docs.n_chars.alias("toxic")))
    assert {r.score for r in toxicity.tag(one, empty).collect()} == {0.5}


def test_toxicity_scores_do_not_depend_on_the_sample_bound(spark):
    # one toxic document in ten; the bound of 200 a class takes all toxic documents and a ninth of the others
    rows = [(i, sentence(i, 12) + (" vile scum" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    ask = spark.createDataFrame([(1, ""), (2, sentence(500, 30)), (3, "vile scum " + sentence(501, 30))], "doc_id long, text string")
    odds = []
    for per_class in (4000, 200):
        tagger = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), per_class=per_class, fold=50)
        odds.append([np.log(r.score / (1 - r.score)) for r in toxicity.tag(ask, tagger).orderBy("doc_id").collect()])
    assert np.abs(np.subtract(*odds)).max() < 0.7, odds  # a share of one half instead of a tenth adds 2.2


def test_forward_backward_equals_enumeration():
    from itertools import product

    emit, moves = np.array([[0.3, -1.0, 2.0, 0.5]]), np.array([[0.2, -0.4], [0.1, 0.7]])
    p, moved, log_z = toxicity.forward_backward(emit, np.ones((1, 4), bool), moves, pairs=True)
    total, one, step = 0.0, np.zeros(4), np.zeros((2, 2))
    for s in product((0, 1), repeat=4):
        w = np.exp(sum(e * x for e, x in zip(emit[0], s)) + sum(moves[a, b] for a, b in zip(s[:-1], s[1:])))
        total += w
        one += w * np.array(s)
        for a, b in zip(s[:-1], s[1:]):
            step[a, b] += w
    assert np.allclose(p[0], one / total) and np.allclose(moved, step / total) and np.isclose(log_z, np.log(total))
