"""Content-addressed WARC archive.

An archive is two tables in one folder. `payloads` holds the bytes of each
distinct payload once, under its SHA-256; `heads` holds the exact header bytes
of each record (WARC and HTTP) and the digest that leads to its payload. A record
is rebuilt by joining the two. Digests are verified twice: on writing, payloads
that share one must agree in length and in a second hash; on reading, each stored
payload is hashed again.

A payload that very many records share is read in copies (`slot`), so that the
join that rebuilds records has no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.skew import join_groups
from tidemark.session import scratch

REVISIT_BYTES = 100
RECORDS_PER_SLOT = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def lines(*parts: str | Column) -> Column:
    """One header line."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("\r\n"))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def head(is_revisit: Column, date: str) -> Column:
    """Exact header bytes of a record, up to its payload. An URL keeps its bytes but for line ends, which are percent-encoded."""
    http = F.concat(lines("HTTP/1.1 200 OK"), lines("Content-Type: text/html; charset=utf-8"), lines("Content-Length: ", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    none = F.lit("")
    size = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("payload_bytes"))
    warc = F.concat(
        lines("WARC/1.1"),
        lines("WARC-Type: ", F.when(is_revisit, "revisit").otherwise("response")),
        lines("WARC-Record-ID: ", record_id(F.col("page_id"))),
        lines("WARC-Date: ", date),
        F.when(F.col("url").isNull(), none).otherwise(lines("WARC-Target-URI: ", url)),
        lines("WARC-Payload-Digest: sha256:", F.col("digest")),
        F.when(is_revisit, F.concat(lines("WARC-Profile: ", PROFILE), lines("WARC-Refers-To: ", record_id(F.col("first_id"))))).otherwise(none),
        lines("Content-Type: application/http; msgtype=response"),
        lines("Content-Length: ", size.cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(warc, http).cast("binary")


def field(text: Column, name: str) -> Column:
    """Value of a header line; null if there is none."""
    found = F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive each page, with html in UTF-8 as payload, in a new folder.

    pages: page_id long, url string, html string; other columns are not read. A null html is an empty payload, a null
    url leaves its line out. Among records of equal payloads of at least REVISIT_BYTES bytes the smallest page_id is the
    response and all others revisit it; rows that repeat that page_id are responses too. A row without page_id revisits
    like any other, and is a response where no record of its payload has a page_id. An empty table gives an archive of
    no records. The write is plain Parquet, so a lost executor costs its tasks only; an archive whose job failed has no
    `heads`.
    """
    spark = pages.sparkSession
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    known = known.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    second = F.xxhash64("payload")
    same = (F.min(second) == F.max(second)) & (F.min("payload_bytes") == F.max("payload_bytes"))
    store = known.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        F.first("payload_bytes").alias("payload_bytes"),
        F.min("page_id").alias("first_id"),
        F.count("*").alias("records"),
        same.alias("same"),
    )
    clash = F.raise_error(F.concat(F.lit("different payloads of digest "), F.col("digest")))
    store = store.withColumn("records", F.when(F.col("same"), F.col("records")).otherwise(clash.cast("long"))).drop("same")
    store.write.parquet(f"{path}/payloads")

    kept = spark.read.parquet(f"{path}/payloads").select("digest", "first_id", "records")
    total = kept.agg(F.sum("records")).first()[0] or 0
    rows = join_groups(known.select("page_id", "url", "digest", "payload_bytes"), kept.where("records > 1"), ["digest"], "records", total)
    is_revisit = F.coalesce((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    slots = F.coalesce(F.floor(F.col("records") / RECORDS_PER_SLOT) + 1, F.lit(1))
    slot = F.pmod(F.xxhash64("page_id", "url"), slots).cast("int")
    rows.select("page_id", "digest", slot.alias("slot"), head(is_revisit, date).alias("head")).write.parquet(f"{path}/heads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records, rebuilt: page_id, record_type, refers_to, payload_bytes, payload_digest (both of the full payload, recomputed), head, payload and record.

    `record` is the exact WARC record without the blank lines that end it. All values but page_id are parsed from the
    stored headers or computed from the stored payload; a payload that is missing or does not hash to its digest is an
    error. Columns that are not used cost nothing: without payload and record, no payload bytes are joined.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    broken = F.raise_error(F.concat(F.lit("broken payload of digest "), F.col("digest")))
    found = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(broken.cast("string"))
    slots = F.sequence(F.lit(0), F.floor(F.col("records") / RECORDS_PER_SLOT).cast("int"))
    held = stored.select("digest", found.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload", slots.alias("slots"))
    held = held.select("digest", "payload_digest", "payload_bytes", "payload", F.explode("slots").alias("slot"))
    rows = spark.read.parquet(f"{path}/heads").join(held, ["digest", "slot"], "left")
    text = F.decode("head", "UTF-8")
    lost = F.raise_error(F.concat(F.lit("no payload of digest "), F.col("digest")))
    sound = lambda c, kind: F.when(F.col("payload_digest").isNotNull(), F.col(c)).otherwise(lost.cast(kind))
    payload = sound("payload", "binary")
    kind = field(text, "WARC-Type")
    refers = F.regexp_extract(F.coalesce(field(text, "WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1)
    return rows.select(
        "page_id",
        kind.alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
        sound("payload_bytes", "long").alias("payload_bytes"),
        sound("payload_digest", "string").alias("payload_digest"),
        "head",
        payload.alias("payload"),
        F.concat("head", F.when(kind == "revisit", F.lit(b"")).otherwise(payload)).alias("record"),
    )


def export_warc(spark: SparkSession, path: str, out: str, compression: str = "none") -> None:
    """Write all records of an archive as plain WARC files: exact records, each ended by two blank lines."""
    records = read_archive(spark, path).select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", compression).text(out)


def op12_warc_archive(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""
