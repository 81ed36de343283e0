"""Fill-in-middle transformation of whole texts.

One `fullmatch` of (unit)* keeps every repetition of its group, so `ends(1)` is
the list of all unit ends: its length is the number of units, and both cuts are
looked up in it. A unit is a word with the white space before it, or the white
space at the end of a text. Cuts and form depend on doc_id and seed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = regex.compile(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)*")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
CUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
FLUSH = 16 << 20


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the id; a null id draws as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(doc_id: int | None, text: str, seed: int = 42, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Cut each whole text at two unit borders and move the middle to its end.

    docs: doc_id long, text string; other columns are not read. One row for each input row, repeated ids and rows too:
    doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output.
    A share of `rate` percent is cut, of these `spm` percent suffix first. Texts that hold a marker stay plain, so that
    `restore` is exact; null and empty texts are plain, empty and of no units. A null doc_id draws as an empty id does.
    An empty table gives no rows. The match takes some 250 bytes a unit of the one text at hand; outputs leave a task in parts of about
    16 MB, so that a batch of very long texts is not held twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows, held = [], 0
            for i, doc_id in enumerate(ids):
                rows.append((doc_id, *cut(doc_id, texts[i].as_py() or "", seed, rate, spm)))
                held += len(rows[-1][-1])
                if held > FLUSH or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CUT, strict=True)], schema=CUT)
                    rows, held = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from; native, from output and form alone."""
    part = F.split(output, "<[PSM]>", 4)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(cuts: DataFrame) -> DataFrame:
    """Adds `text`, rebuilt from output and form; columns of that name are replaced."""
    return cuts.withColumn("text", restored(F.col("output"), F.col("form")))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    done = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), d AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT *, array_to_string(units[:least(x, y)], '') AS a, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS b,
         array_to_string(units[greatest(x, y) + 1:], '') AS c
  FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
