"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers beside them.

An archive is a folder of two tables. ``payloads`` (digest, length, payload)
holds each distinct payload once under its SHA-256. ``headers`` (record_no,
header, digest, stored) holds every record's header text as it is, the digest of
its payload and whether the record itself carries that payload (response) or
refers to another (revisit). Joins by digest rebuild each original record to the
byte; digests are computed again on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import read, scratch

#: Equal payloads of at least so many bytes are stored as one response and revisits.
LEAST_SHARED = 1000
CRLF = "\r\n"


def record_header(kind: Column, number: Column, target: Column, sha1: Column, refers: Column, length: Column) -> Column:
    """A WARC/1.1 header with its blank line; a revisit carries no block and names its response.

    A header line can't hold line ends, so those of a target are percent-encoded. A
    record without number has the id ``urn:page:none``.
    """
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    date = F.lit("WARC-Date: 2024-01-01T00:00:00Z" + CRLF)
    revisit = F.concat(
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))),
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
    )
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">"))),
        date,
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace(F.coalesce(target, F.lit("")), "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit(0)).otherwise(length).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST_SHARED) -> None:
    """Write one record per row of ``pages``; a null body is an empty payload, a null url an empty target.

    Of equal payloads of at least ``least`` bytes the row with the largest key is
    the response; rows without key revisit it, and are responses where no row of
    the payload has one. Rows with equal keys and payloads write equal records. Copies
    are combined before the shuffle, so a payload with very many takes one row a
    task.
    """
    payload = F.coalesce(F.encode(F.col(body), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).alias("record_no"), F.col(url).alias("target"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.length("payload").cast("long"), "sha1": F.sha1("payload")})
    stored = rows.groupBy("digest").agg(F.first("length").alias("length"), F.first("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")
    light = rows.drop("payload")
    leaders = light.filter(F.col("length") >= least).groupBy("digest").agg(F.max("record_no").alias("leader"))
    said = light.join(leaders, "digest", "left")
    follows = F.coalesce(F.col("record_no") < F.col("leader"), F.col("leader").isNotNull())
    kind = F.when(follows, F.lit("revisit")).otherwise(F.lit("response"))
    header = record_header(kind, F.col("record_no"), F.col("target"), F.col("sha1"), F.col("leader"), F.col("length"))
    said.select("record_no", header.alias("header"), "digest", (~follows).alias("stored")).write.parquet(f"{path}/headers")


def _verified(payloads: DataFrame) -> DataFrame:
    """Fail on a stored payload that isn't what its digest says."""
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.length("payload") == F.col("length"))
    return payloads.filter(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("digest"))).cast("boolean")))


def header_field(header: Column, name: str) -> Column:
    """A field of an exact header text, null where absent."""
    found = F.regexp_extract(header, rf"(?s)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(header.contains(f"\r\n{name}: "), found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, header, payload, record): every original record, rebuilt by joining headers with verified payloads.

    ``payload`` is the full payload, of a revisit that of its response; ``record``
    is the record as written: header, block and the two closing line ends.
    """
    headers = spark.read.parquet(f"{path}/headers")
    met = headers.join(_verified(spark.read.parquet(f"{path}/payloads")), "digest")
    block = F.when(F.col("stored"), F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n"))
    return met.select("record_no", "header", "payload", record.alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, payload_bytes, payload_digest, record_type, refers_to) of every record as it is rebuilt.

    Each record must end with the block that its Content-Length tells of, and its
    payload must have the SHA-1 that its header names. Type and reference are
    parsed from the header.
    """
    rebuilt = read_records(spark, path).withColumn("payload_digest", F.sha1("payload"))
    header = F.col("header")
    told = header_field(header, "Content-Length").cast("long") + F.octet_length(header) + 4
    sound = (header_field(header, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.length("record") == told)
    met = rebuilt.filter(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("record isn't what its header says: "), header)).cast("boolean")))
    refers = F.regexp_extract(header_field(header, "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).cast("long")
    return met.select(
        "record_no", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", header_field(header, "WARC-Type").alias("record_type"), refers.alias("refers_to")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_index(spark, path).withColumnRenamed("record_no", "page_id")


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS leader FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < leader THEN leader END AS refers_to
FROM m
"""
