"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes is reduced to one signed row per key and added to the totals,
which are stored: reading them costs their own few rows, whatever has been
committed. Each commit writes a new version of the totals, and then, as one
step, a log entry that names it and the batches in it. A batch that was
committed before is not added again, so repeating a commit, after a failure or
by mistake, changes nothing. Totals are sums, so batches can come in any order.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.skew import join_groups
from tidemark.session import scratch

KEY = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer versions as counts over a text; a null or empty text has no tokens.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """One row per key with the signed sums of a batch.

    changes: kind (insert, delete or revise), source, lang, tokenizer, n_tokens (the count now; unused by a delete) and
    was_tokens (the count so far; unused by an insert). Null keys are keys of their own, null counts are 0, and rows of
    another kind count for nothing. Partial sums leave each task, so a source with a third of all rows is no hot key.
    """
    now, was = F.coalesce("n_tokens", F.lit(0)), F.coalesce("was_tokens", F.lit(0))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("kind") == "insert", now).when(F.col("kind") == "delete", -was).when(F.col("kind") == "revise", now - was).otherwise(0)
    return changes.groupBy(*KEY).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Totals under a folder all executors share; one writer at a time.

    The log entry lists the last RECENT batch ids; each older one has a file of its own in `_batches`, written before
    the entry lets go of it. Of old versions the last KEPT stay, for readers that began with them.
    """

    RECENT, KEPT = 1000, 10

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _state(self) -> dict:
        """The newest log entry."""
        entries = [n for n in self._names("_log") if n.endswith(".json")]
        if not entries:
            return {"number": 0, "totals": None, "recent": []}
        return json.loads(self.spark.read.text(f"{self.path}/_log/{entries[-1]}", wholetext=True).first().value)

    def _write_file(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        draft, at = self._at(f"{self.path}/_draft-{uuid.uuid4().hex}"), self._at(f"{self.path}/{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(at.getParent())
        if not self._fs.rename(draft, at):
            raise RuntimeError(f"{name} is there already: another writer was at work")

    def committed(self, batch: str, state: dict | None = None) -> bool:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch[0] in "._":
            raise ValueError(f"no batch id: {batch!r}")
        return batch in (state or self._state())["recent"] or self._fs.exists(self._at(f"{self.path}/_batches/{batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch to the totals; False if it was added before. What a failed attempt left behind is not seen."""
        state = self._state()
        if self.committed(batch, state):
            return False
        rows = signed(changes)
        if state["totals"]:
            rows = self._read(state["totals"]).unionByName(rows).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        number = state["number"] + 1
        version = f"totals-{number:012d}-{uuid.uuid4().hex[:8]}"
        rows.where("n_docs <> 0 OR n_tokens <> 0").write.parquet(f"{self.path}/{version}")
        recent = [*state["recent"], batch]
        for old in recent[: -self.RECENT]:
            if not self._fs.exists(self._at(f"{self.path}/_batches/{old}")):
                self._write_file(f"_batches/{old}", "")
        self._write_file(f"_log/{number:012d}.json", json.dumps({"number": number, "totals": version, "recent": recent[-self.RECENT :]}))
        gone = f"{number - self.KEPT:012d}"
        for name in [f"_log/{gone}.json", *(n for n in self._names("") if n.startswith(f"totals-{gone}"))]:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)
        return True

    def _read(self, version: str) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{version}")

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys whose documents and tokens have all gone are left out."""
        version = self._state()["totals"]
        return self._read(version) if version else self.spark.createDataFrame([], TOTALS)


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under both tokenizers, exact copies of a smaller doc_id deleted, counts of the others
    revised after digits are masked; the revision is delivered twice. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    masked = F.regexp_replace("text", "[0-9]+", "")
    each = [F.struct(F.lit(t).alias("tokenizer"), count_tokens(F.col("text"), t).alias("before"), count_tokens(masked, t).alias("after")) for t in TOKENIZERS]
    path = scratch(spark, "token-counts")
    docs.select("doc_id", "source", "lang", F.md5("text").alias("digest"), F.array(*each).alias("counts")).write.parquet(path)
    counted = spark.read.parquet(path)
    first = counted.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # a text that many documents share is no hot key, and one that none shares needs no partner
    judged = join_groups(counted, first.where("n > 1"), ["digest"], "n", counted.count())
    judged = judged.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("n")
    rows = judged.select("source", "lang", "copy", F.explode("counts").alias("c")).select("source", "lang", "copy", "c.*")
    changes = lambda kind, now, was: rows.select(F.lit(kind).alias("kind"), *KEY, now.alias("n_tokens"), was.alias("was_tokens"), "copy")
    before, after, none = F.col("before"), F.col("after"), F.lit(None).cast("long")
    rollup = Rollup(spark, scratch(spark, "token-rollup"))
    rollup.commit("1-insert", changes("insert", before, none))
    rollup.commit("2-delete", changes("delete", none, before).where("copy"))
    for _ in range(2):
        rollup.commit("3-revise", changes("revise", after, before).where("NOT copy"))
    return rollup.totals()


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, lang, text, regexp_replace(text, '[0-9]+', '', 'g') AS masked,
         min(doc_id) OVER (PARTITION BY md5(text)) AS first
  FROM documents
), kept AS (SELECT * FROM d WHERE text IS NULL OR doc_id = first), counted AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(masked, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'alnum-1', coalesce(len(regexp_extract_all(masked, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 0) FROM kept
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM counted GROUP BY source, lang, tokenizer
"""
