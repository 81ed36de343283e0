"""A training corpus from documents: five stages, each over all rows that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs. `run` writes each result as Parquet in the shared
folder and reads it again for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, piece_codec, suffix_dedup, toxicity
from tidemark.session import scratch


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores at one half or more go. It is fitted on the labelled rows of sf_dir."""
    tagger, _ = toxicity.learned(spark, sf_dir)
    return toxicity.reject(docs, tagger)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents the smallest doc_id stays; of rows that repeat a doc_id and its text, one. Rows without doc_id stay."""
    found = jaccard_join.jaccard_components(docs)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi")
    both = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")  # two hashes of a text stand for it, so that texts are not grouped by
    kept = kept.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), *[h.alias(f"_h{i}") for i, h in enumerate(both)])
    kept = kept.dropDuplicates(["_id", "_h0", "_h1"]).select("_row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings are cut from the texts and n_chars counted again; no row goes. Rows without doc_id stay as they are."""
    rest = suffix_dedup.dedup_spans(docs).where("copy = 0").select("doc_id", "text_hash", F.struct("kept_text", "n_removed").alias("_kept"))
    cut = F.col("_kept.n_removed") > 0
    # joined on an expression, so that no column of docs can clash
    rest = rest.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_kept")
    done = docs.join(rest, (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash")), "left")
    columns = [F.when(cut, F.col("_kept.kept_text")).otherwise(F.col(c)).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        columns[at] = F.when(cut, F.length("_kept.kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go: at least one hit word, and a twentieth of all words."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (the ids decode to the text) of every document."""
    return piece_codec.encode_documents(docs, piece_codec.public_model(), piece_codec.TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_spans),
    ("decontamination", benchmark_passages),
    ("sentencepiece", tokens),
]

#: No SQL for a conditional random field, a transitive closure over shingle sets or BPE: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
