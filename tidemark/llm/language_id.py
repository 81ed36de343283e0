"""Language identification by compression.

Each language has a zstandard dictionary of raw sample text. Letters are
lower-cased and all else becomes a space; the text is cut into
blocks, so that a long text does not become its own dictionary; every block is
compressed under every dictionary, and the language with the smallest sum of
compressed sizes wins. A narrow margin to the second is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import table
from tidemark.llm.sampling import by_hash

BLOCK, LEVEL = 4096, 6
RESULT = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
UNDETERMINED = "und"


def sample(docs: DataFrame, per_language: int, chars: int) -> dict[str, str]:
    """Text of each language for its dictionary: `chars` characters of each of `per_language` documents.

    The documents are those with the smallest hashes of doc_id, so that the sample is the same in any order of rows, and
    the characters begin anywhere in the text, at a place that the hash gives too.
    Languages come in order of their number of documents.
    """
    places = F.greatest(F.length("text") - chars + 1, F.lit(1))
    block = F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(7), "doc_id"), places) + 1).cast("int"), F.lit(chars))
    picked, count = by_hash(docs.where("length(text) > 0").select("doc_id", "lang", block.alias("text")), "lang", per_language)
    out: dict[str, list[str]] = {}
    for r in picked.select("lang", "text", "rank").orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.text)
    return {lang: "\n".join(out[lang]) for lang in sorted(out, key=lambda x: (-count[x], x))}


@lru_cache(maxsize=4)
def compressors(samples: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, text in samples:
        dictionary = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return made


NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).encode()


def sizes(text: bytes, made: list[tuple[str, zstandard.ZstdCompressor]]) -> list[int]:
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for _, c in made]


def identify(docs: DataFrame, samples: dict[str, str], min_margin: float = 0.01, sharpness: float = 200.0) -> DataFrame:
    """Language of each whole text. docs: doc_id long, text string; other columns are not read.

    One row for each input row. lang_pred is the language whose dictionary gives the smallest size (of equals the
    first in `samples`), or `und` if the text is null or has no letter, or if no language is known. margin is the share
    of the second best size that the best one saves, score is 1 / (1 + exp(-sharpness * margin)) and 0 for `und`.
    rejected: margin below min_margin, or `und`. With one known language the margin is 1.
    """
    known = tuple((lang, letters(text)) for lang, text in samples.items() if text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import exp

        made = compressors(known)
        for batch in batches:
            rows, ids, texts = [], batch.column("doc_id").to_pylist(), batch.column("text")
            for i, doc in enumerate(ids):
                text = texts[i].as_py() or ""
                if not made or not any(map(str.isalpha, text)):
                    rows.append((doc, UNDETERMINED, 0.0, 0.0, True))
                    continue
                each = sizes(letters(text), made)
                best = min(range(len(each)), key=each.__getitem__)
                rest = [s for j, s in enumerate(each) if j != best]
                margin = 1 - each[best] / min(rest) if rest else 1.0
                rows.append((doc, made[best][0], 1 / (1 + exp(-sharpness * margin)), margin, margin < min_margin))
            if rows:
                yield from table(rows, RESULT).to_batches()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, RESULT)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    learned = sample(docs.where(part != 2), per_language=800, chars=500)
    return identify(docs, learned).select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
