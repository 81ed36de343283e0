"""Operators 2 and 3, and the pipeline."""

import math
import random

import corpus_pipeline
from tidemark.llm import token_rollup, vector_search
from tidemark.session import scratch


def test_search_recall_and_scores(small_corpus):
    vectors = small_corpus("sf0.1", "embeddings")
    index = vector_search.build(vector_search.usable(vectors), 0.01)
    got = vector_search.search(vectors, vectors.where("vec_id % 100 = 0"), index).collect()
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    hit = total = 0
    for q in (i for i in rows if i % 100 == 0):
        near = sorted((math.dist(rows[q], v), i) for i, v in rows.items() if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda r: (r[2], r[1]))
        assert all(math.isclose(s, math.dist(rows[q], rows[i]), rel_tol=1e-12) for _, i, s in mine)
        hit, total = hit + len({i for _, i in near} & {i for _, i, _ in mine}), total + 10
    assert hit >= 0.9 * total


def test_search_of_odd_vectors(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randrange(3)) + 1 for _ in range(4)]) for i in range(8)] + [(8, rows0 := [1.0, 1.0, 1.0, 1.0]), (9, rows0), (9, rows0)]
    odd = [(20, None), (21, [0.0] * 4), (22, [1.0, None, 1.0, 1.0]), (23, [float("nan")] * 4), (24, [float("inf"), 1.0, 1.0, 1.0]), (None, rows0), (25, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int")
    index = vector_search.build(vector_search.usable(df), 1.0)
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in vector_search.search(df, df, index).collect()}
    for q, v in rows:
        want = sorted({(math.dist(v, u), i) for i, u in rows if i != q})
        assert [(got[q, k + 1][1], got[q, k + 1][0]) for k in range(len(want))] == want
    assert {q for q, _ in got} == {i for i, _ in rows}
    none = df.limit(0)
    assert vector_search.search(none, none, vector_search.build(vector_search.usable(none), 1.0)).count() == 0


def test_search_finds_k_for_outliers_and_beside_a_hot_vector(spark):
    r = random.Random(5)
    rows = [(i, [10 * (i % 12) + r.gauss(0, 0.1), r.gauss(0, 0.1), 1.0]) for i in range(600)]
    rows += [(600 + i, [5.0, 5.0, 5.0]) for i in range(300)]  # a third is one vector
    rows += [(900 + i, [1000.0 * (i + 1), -2000.0 * i, 1.0]) for i in range(5)]  # each alone in its list
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    index = vector_search.build(vector_search.usable(df), 0.1, lists=60)
    centroids = {tuple(c.round(9)) for c in index.centroids}
    assert len(centroids) == len(index.centroids)
    index.probes = 1  # as a table of tight clusters gives
    asked = [0, 7, 600, *range(900, 905)]
    got = vector_search.search(df, df.where(df.vec_id.isin(asked)), index).collect()
    at = dict(rows)
    for q in asked:
        mine = sorted((x.rank, x.vec_id) for x in got if x.query_id == q)
        assert [k for k, _ in mine] == list(range(1, 11)), q
        if q >= 900:
            assert [v for _, v in mine] == [i for _, i in sorted((math.dist(at[q], v), i) for i, v in rows if i != q)[:10]]


def test_rollup_adds_signed_batches_once(spark):
    cols = "kind string, source string, lang string, tokenizer string, n_tokens long, was_tokens long, n_docs int"
    rollup = token_rollup.Rollup(spark, scratch(spark, "rollup-test"))
    assert rollup.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", "t", 5, None, 9), ("insert", "a", "en", "t", 7, None, 9), ("insert", None, None, "t", None, None, 9)], cols)
    two = spark.createDataFrame([("revise", "a", "en", "t", 4, 5, 9), ("delete", "a", "en", "t", None, 7, 9), ("delete", None, None, "t", None, None, 9), ("other", "a", "en", "t", 99, 1, 9)], cols)
    assert rollup.commit("two", two) and rollup.commit("one", one)  # in any order
    assert not rollup.commit("one", one) and not rollup.commit("two", two)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 4)]
    assert rollup.commit("three", spark.createDataFrame([], cols)) and rollup.totals().count() == 1


def test_rollup_ignores_a_batch_that_was_not_finished(spark):
    path = scratch(spark, "rollup-broken")
    rollup = token_rollup.Rollup(spark, path)
    row = spark.createDataFrame([("insert", "a", "en", "t", 5, None)], "kind string, source string, lang string, tokenizer string, n_tokens long, was_tokens long")
    token_rollup.signed(row).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=x")
    assert rollup.totals().count() == 0 and rollup.commit("x", row) and rollup.totals().first().n_tokens == 5


def test_rollup_reads_stored_totals_and_forgets_no_batch(spark, monkeypatch):
    monkeypatch.setattr(token_rollup.Rollup, "RECENT", 3)
    monkeypatch.setattr(token_rollup.Rollup, "KEPT", 2)
    rollup = token_rollup.Rollup(spark, scratch(spark, "rollup-long"))
    cols = "kind string, source string, lang string, tokenizer string, n_tokens long, was_tokens long"
    row = lambda i: spark.createDataFrame([("insert", f"s{i % 2}", "en", "t", i, None), ("insert", "gone", "en", "t", 1, None), ("delete", "gone", "en", "t", None, 1)], cols)
    for i in range(8):
        assert rollup.commit(f"b{i}", row(i))
    assert not any(rollup.commit(f"b{i}", row(99)) for i in range(8))  # those of the log entry and those before it
    totals = rollup.totals()
    assert sorted(tuple(r) for r in totals.collect()) == [("s0", "en", "t", 4, 12), ("s1", "en", "t", 4, 16)]
    assert len({f.rsplit("/", 2)[1] for f in totals.inputFiles()}) == 1  # one version, no log of deltas
    assert len([n for n in rollup._names("") if n.startswith("totals-")]) == 2 and len(rollup._names("_log")) == 2


def test_rollup_query_on_empty_and_repeated_rows(spark, tmp_path):
    rows = [(1, "a b 12", "x", "en"), (1, "a b 12", "x", "en"), (2, "a b 12", "x", "en"), (3, None, None, "de"), (None, "q", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for name, some in (("some", df), ("none", df.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup.op3_token_rollup(spark, f"{tmp_path}/some").collect()}
    assert got["x", "en", "words-1"] == (2, 4) and got[None, "de", "words-1"] == (1, 0) and got["x", None, "alnum-1"] == (1, 1)
    assert token_rollup.op3_token_rollup(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages(spark, docs, no_docs, small_corpus):
    sf = "/root/testdata/sf0.001"
    for stage_docs in (docs, no_docs):
        now = stage_docs
        for name, stage in corpus_pipeline.STAGES:
            path = scratch(spark, f"stage-{name}")
            stage(spark, now, sf).write.parquet(path)
            done = spark.read.parquet(path)
            if name != "sentencepiece":
                assert done.columns == stage_docs.columns, name
            now = done
        if stage_docs is no_docs:
            assert now.count() == 0
    ids = [r.doc_id for r in now.collect()] if stage_docs is docs else []
    assert len(ids) == len(set(ids))
    total = corpus_pipeline.run(spark, sf)
    assert 0 < total.count() < small_corpus("sf0.001", "documents").count() and total.where("NOT round_trip").count() == 0


def test_near_duplicate_stage_keeps_one_of_each(spark, docs):
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert kept.count(17) == 1 and kept.count(None) == 1 and 1 in kept and not {2, 3} & set(kept) and {5, 6, 7} <= set(kept)


def test_repeated_span_stage_cuts_texts(spark, docs):
    rows = corpus_pipeline.repeated_spans(spark, docs, "").collect()
    texts = {r.doc_id: r.text for r in rows}
    assert len(rows) == docs.count() and texts[1] == texts[2] == "" and texts[5] is None and texts[8] == "Two words"
