"""Cases that a contract fixes: ids with two texts, letters, long texts, and memory that does not grow with them."""

import random

import numpy as np

import corpus_pipeline
from tests.llm.conftest import LONG, sentence
from tests.llm.test_dedup import brute_bytes
from tidemark.llm import decontaminate, jaccard_join, language_id, suffix_dedup
from tidemark.llm import text as rolling


def test_numbers_and_signs_are_no_letters(spark):
    texts = ["½ ² ③ Ⅷ", "①½²", "12 !", "ª", "½ a", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, {"en": "the cat and the dog", "de": "der Hund und die Katze"}).collect()}
    assert {i for i, lang in got.items() if lang == "und"} == {0, 1, 2, 5}


def test_an_item_with_two_texts_has_the_windows_of_both(spark):
    a, b = sentence(31, 20), sentence(32, 20)
    items = spark.createDataFrame([("x", a), ("x", b), ("x", a)], "item_id string, text string").repartition(3)
    docs = spark.createDataFrame([(1, a), (2, b), (3, sentence(33, 40))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (20, 20, 1, "x"), 2: (20, 20, 1, "x"), 3: (40, 0, 0, "")}


def test_every_text_of_a_repeated_id_is_linked(spark):
    long = sentence(41, 60)
    rows = [(1, "short text"), (1, long), (1, long), (2, long + " end"), (3, "short text"), (4, sentence(42, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(df, layout=(5, 16)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({(1, "short text"), (1, long), (4, sentence(42, 50))})


def test_spans_of_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    r = random.Random(9)
    rows = [(i, " ".join(r.choice([LONG, sentence(50 + i, 90), "na " * 300]) for _ in range(3))) for i in range(5)] + [(9, "é" * 700), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (400, 60):
        got = suffix_dedup.dedup_spans(df, length, layout=(2, 16, 16)).collect()
        assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute_bytes(rows, length)


def test_power_tables_stay_small_and_hashes_depend_on_content_alone():
    rng = np.random.default_rng(6)
    for n in (40, rolling.TABLE, rolling.TABLE + 1, 1 << 20, 3 << 20):
        data = rng.integers(0, 256, n).astype(np.uint8)
        start = np.array([0, n // 2, n - 9])
        for b in rolling.BASES:
            one = rolling.spans_hash(rolling.prefix(data, b), start, start + 9, b)
            moved = rolling.spans_hash(rolling.prefix(np.concatenate([data[:5], data]), b), start + 5, start + 14, b)
            assert (one == moved).all()
            assert (rolling.rolling_hash(rolling.prefix(data, b), 9, b)[start] == one).all()
            assert one[0] == sum((int(x) + 1) * pow(b, i, 1 << 64) for i, x in enumerate(data[:9])) % (1 << 64)
    kept = rolling._table.cache_info()
    assert kept.currsize <= kept.maxsize == 2 * len(rolling.BASES)
    assert sum(rolling._table(b).nbytes for b in rolling.BASES) * 2 <= 16 << 20
