"""Content-addressed web archive.

The bytes of a payload are kept once, under their SHA-256; the headers of a
record are kept exactly, apart from the payload. The original records are the
headers joined to the payloads. A payload is verified against its address
whenever it is read.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from locigrid.llm.common import text_or_empty

# Payloads from this size on are revisited rather than repeated.
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
# Fixed text of the format.
VERSION = "WARC/1.0"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = "\r\n"


def _id(page: Column) -> Column:
    """A record id made from the page's own, the same in every run."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit(""))))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _line(name: str, value: Column) -> Column:
    """A header line, left out where the value is missing; line breaks in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(END)), F.lit(""))


def record_headers(pages: DataFrame, owners: DataFrame) -> DataFrame:
    """page_id, record_type, address and the exact header bytes of one record per page."""
    payload = text_or_empty("html").cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.sha2(payload, 256).alias("address"),
        F.sha1(payload).alias("digest"),
        F.length(payload).cast("long").alias("bytes"),
    )
    joined = rows.join(owners.select(F.col("address").alias("__address"), "owner", "url_of_owner"), F.col("address") == F.col("__address"), "left")
    revisit = (F.col("bytes") >= LEAST_BYTES) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    head = F.concat(
        F.lit(VERSION + END),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<"), _id(F.col("page_id")), F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), _id(F.col("owner")), F.lit(">")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("url_of_owner"))),
        _line("X-Refers-To-Page", F.when(revisit, F.col("owner"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
        F.lit(END),
    )
    return joined.select("page_id", "address", F.encode(head, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, folder: str) -> None:
    """Write ``pages`` (page_id, url, html) as an archive in ``folder``.

    ``payloads`` holds address, owner and payload, each content once; the owner
    is the largest page_id that has it. ``headers`` holds a row per page. A
    missing html is an empty payload; a missing page_id owns nothing unless all
    pages of a payload lack one. Rows of one page_id and payload that are
    repeated are all responses, or all revisits. Copies are reduced before the
    shuffle, so a payload that very many pages share makes no large task.
    """
    payload = text_or_empty("html").cast("binary")
    rows = pages.select(
        F.sha2(payload, 256).alias("address"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    )
    once = rows.groupBy("address").agg(F.max(F.struct("page_id", "url")).alias("top"), F.first("payload").alias("payload"))
    once.select("address", F.col("top.page_id").alias("owner"), F.col("top.url").alias("url_of_owner"), "payload").write.parquet(f"{folder}/payloads")
    owners = pages.sparkSession.read.parquet(f"{folder}/payloads").select("address", "owner", "url_of_owner")
    record_headers(pages, owners).write.parquet(f"{folder}/headers")


def header_value(name: str) -> Column:
    """Value of a header line of ``header``, null where there is none."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """address and payload; reading fails where bytes do not have their address."""
    rows = spark.read.parquet(f"{folder}/payloads")
    right = F.sha2("payload", 256) == F.col("address")
    return rows.select("address", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address")))).alias("payload"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record and full_payload: the original bytes of every record, joined from headers and payloads.

    The record of a revisit has no body; its full payload is that of the record
    it refers to.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    joined = headers.join(verified_payloads(spark, folder), "address")
    body = F.when(header_value("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header"), body, F.lit((END + END).encode()))
    return joined.select("page_id", record.alias("record"), F.col("payload").alias("full_payload"))


def export_warc(spark: SparkSession, folder: str, out: str) -> None:
    """Write the records to WARC files; each is text that ends with a line feed, as the text writer puts there."""
    records = read_records(spark, folder).select(F.expr("substring(record, 1, length(record) - 1)").cast("string").alias("value"))
    records.write.text(out)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read back from the archive.

    Sizes and digests are taken from the stored bytes, once per payload; types
    and references from the stored headers. A header whose digest or length
    differs from the bytes fails the read.
    """
    payloads = verified_payloads(spark, folder).select("address", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    joined = spark.read.parquet(f"{folder}/headers").join(payloads, "address")
    kind = header_value("WARC-Type")
    length = F.when(kind == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    right = (header_value("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (header_value("Content-Length").cast("long") == length)
    checked = F.when(right, kind).otherwise(F.raise_error(F.concat(F.lit("header does not fit payload "), F.col("address"))))
    refers = header_value("X-Refers-To-Page").cast("long")
    return joined.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), refers.alias("refers_to"))


SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
  q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS top FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> top THEN top END AS refers_to FROM q"""
