"""Content-addressed WARC archives.

An archive is two tables. ``payloads`` holds each different payload once under its SHA-256;
``records`` holds, for each record, its exact header bytes and the payload's digest. A
record's original bytes are the header, the payload and the closing line ends, and come back
by a join. Payload bytes are verified against their digest as they are read.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerspark.sources.tables import durable, shared_folder

#: Payloads of fewer bytes are archived in full each time.
LEAST_REVISIT_BYTES = 1000
# Parts of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
RECORD_END = "\r\n\r\n"
#: One moment of capture for all records, as the pages carry none.
DATE = "2024-01-01T00:00:00Z"


def record_uri(key: Column) -> Column:
    """A record id made of a page's id; a page without one gets that of an empty id."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(LINE))


def header(url: Column, page: Column, revisits: Column, sha1: Column, sha256: Column, n: Column) -> Column:
    """WARC and HTTP header text of a record; ``revisits`` is the page whose payload it repeats."""
    is_revisit = revisits.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}"), line("Content-Type", "text/html; charset=utf-8"),
                    line("Content-Length", n.cast("string")), F.lit(LINE))
    body = F.when(is_revisit, F.lit(0)).otherwise(n)
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(f"{VERSION}{LINE}"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_uri(page)),
        line("WARC-Date", DATE),
        line("WARC-Target-URI", clean),
        F.when(page.isNotNull(), line("X-Page-ID", page.cast("string"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("X-Payload-SHA256", sha256),
        F.when(is_revisit, F.concat(
            line("WARC-Profile", PROFILE), line("WARC-Refers-To", record_uri(revisits)),
            line("X-Refers-To-Page-ID", revisits.cast("string")))).otherwise(""),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", (F.octet_length(http) + body).cast("string")),
        F.lit(LINE), http)


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the two tables of an archive of ``pages`` under ``path``.

    A payload is the html in UTF-8, empty for null. Of records with equal payloads of at
    least ``LEAST_REVISIT_BYTES``, those with the largest page id are responses and the
    others revisit them; a page without id ranks below all others, and is a response where
    no equal payload has an id. Repeated rows make repeated records. Other columns of
    ``pages`` are not archived. An empty table makes an empty archive.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    read = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256)
    # One row for each payload: combined before the shuffle, so copies hardly travel.
    read.groupBy(digest.alias("sha256")).agg(F.first("payload").alias("payload")).withColumn(
        "sha1", F.sha1("payload")).write.parquet(f"{path}/payloads")
    meta = durable(read.select("page", "url", F.octet_length("payload").cast("long").alias("n"),
                               digest.alias("sha256"), F.sha1("payload").alias("sha1")))
    owners = meta.filter(F.col("n") >= LEAST_REVISIT_BYTES).groupBy("sha256").agg(
        F.max("page").alias("owner"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    joined = meta.join(owners, "sha256", "left")
    revisits = F.when(~F.col("page").eqNullSafe(F.col("owner")), F.col("owner"))
    joined.select(
        "sha256", "n", header(F.col("url"), F.col("page"), revisits, F.col("sha1"), F.col("sha256"),
                              F.col("n")).cast("binary").alias("header"),
        revisits.isNull().alias("has_payload"),
    ).write.parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, verified: bytes that do not match their digest raise an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("sha256")
    return stored.select("sha256", F.when(good, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), "sha256"))).alias("payload"), "sha1")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records with their ``header``, full ``payload`` and original bytes ``record``.

    The records of a payload that very many share are split over tasks by adaptive
    execution; that payload then goes to each of them.
    """
    records, payloads = spark.read.parquet(f"{path}/records"), read_payloads(spark, path)
    body = F.when(F.col("has_payload"), F.col("payload")).otherwise(F.lit("").cast("binary"))
    return records.join(payloads, "sha256").select(
        "sha256", "header", "payload", F.concat("header", body, F.lit(RECORD_END).cast("binary")).alias("record"))


def field(text: Column, name: str) -> Column:
    """Value of a header line; null where there is none."""
    found = F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def parse_headers(records: DataFrame, page_type: str = "bigint") -> DataFrame:
    """Add page, record type and the page referred to, read from the header bytes."""
    text = F.decode("header", "utf-8")
    return records.select("*", field(text, "X-Page-ID").cast(page_type).alias("page_id"),
                          field(text, "WARC-Type").alias("record_type"),
                          field(text, "X-Refers-To-Page-ID").cast(page_type).alias("refers_to"),
                          F.substring_index(field(text, "WARC-Payload-Digest"), ":", -1).alias("declared_sha1"))


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back, parsed."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid4().hex}"
    write_archive(pages, path, page_id, url, html)
    return parse_headers(read_records(spark, path), pages.schema[page_id].dataType.simpleString())
