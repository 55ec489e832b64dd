"""A content-addressed WARC archive: payloads once by digest, exact record headers apart, records rebuilt by a join.

``write_archive`` writes two Parquet tables: ``payloads`` (sha256, payload) with one row for each different payload, and
``headers`` (page_id, sha256, header) with the exact bytes of every record up to its payload. A digest counts as verified
when all rows that share it also share SHA-1 and length; a clash ends the job. ``read_archive`` joins the two back and
checks both digests and the declared length of each record.

Definitions: a null payload is an empty one. Of records with equal payloads of at least ``min_bytes``, the one with the
largest id is the response and the others are revisits of it; ids that tie are all responses. Smaller payloads are always
responses. A null url becomes ``urn:weirworks:unknown``; the line breaks of any reader (``BREAKS``) are percent-encoded in a
url, so that they cannot start a header. A record with a null id is kept, never refers to itself, and reads back with a null id. An empty table gives empty tables. Extra
columns are ignored.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.llm.common import pick

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:weirworks:page:"
UNKNOWN_URL = "urn:weirworks:unknown"
END = "\r\n\r\n"
#: Characters that some reader takes for the end of a line.
BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def _field(name: str, *value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit("\r\n"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def addressed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, n, sha256, sha1) of every page."""
    rows = pick(pages, page_id=id_col, url=url_col, payload=payload_col)
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = rows.withColumn("payload", payload)
    return rows.select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("n"),
        F.unhex(F.sha2("payload", 256)).alias("sha256"), F.sha1("payload").alias("sha1"),
    )


def _keepers(rows: DataFrame) -> DataFrame:
    """(sha256, keeper): the largest id that holds a payload; fails if two payloads share a digest."""
    facts = rows.groupBy("sha256").agg(
        F.max("page_id").alias("keeper"), F.min("sha1").alias("a"), F.max("sha1").alias("b"), F.min("n").alias("c"), F.max("n").alias("d")
    )
    clash = (F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))
    return facts.select("sha256", F.when(clash, F.raise_error(F.lit("two payloads share a SHA-256"))).otherwise(F.col("keeper")).alias("keeper"))


def header_of(page_id: Column, url: Column, n: Column, sha1: Column, keeper: Column, revisit: Column, date: str) -> Column:
    """The exact bytes of a record before its payload: WARC fields, an empty line, HTTP fields, an empty line."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _field("Content-Length", n.cast("string")), F.lit("\r\n"))
    target = url
    for char in BREAKS:
        target = F.replace(target, F.lit(char), F.lit(quote(char)))
    target = F.coalesce(target, F.lit(UNKNOWN_URL))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(n)
    fields = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(page_id)),
        _field("WARC-Date", date),
        _field("WARC-Target-URI", target),
        _field("WARC-Payload-Digest", "sha1:", sha1),
        F.when(revisit, F.concat(_field("WARC-Profile", REVISIT_PROFILE), _field("WARC-Refers-To", _record_id(keeper)))).otherwise(F.lit("")),
        _field("Content-Type", "application/http; msgtype=response"),
        _field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(fields, http).cast("binary")


def write_archive(
    pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> None:
    """Write the two tables below ``path``."""
    rows = addressed(pages, id_col, url_col, payload_col)
    # Ids and digests decide first, so that the payloads themselves move only once, to be stored.
    keepers = _keepers(rows.select("page_id", "n", "sha256", "sha1"))
    facts = rows.select("page_id", "url", "n", "sha256", "sha1").join(keepers, "sha256")
    revisit = F.coalesce((F.col("n") >= min_bytes) & (F.coalesce(F.col("page_id") != F.col("keeper"), F.col("keeper").isNotNull())), F.lit(False))
    header = header_of(F.col("page_id"), F.col("url"), F.col("n"), F.col("sha1"), F.col("keeper"), revisit, date)
    facts.select("page_id", "sha256", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    once = rows.groupBy("sha256").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload) of every record, from the stored bytes; revisits get the payload they refer to."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
    return headers.join(payloads.select("sha256", checked.alias("payload")), "sha256").select("page_id", "header", "payload")


def parsed(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), all from the record's own bytes.

    Fails where a header's digest or length is not that of the payload.
    """
    header = F.decode("header", "UTF-8")
    head = F.substring_index(header, END, 1)
    http = F.octet_length("header") - F.octet_length(head) - len(END)

    def value(name: str) -> Column:
        return F.regexp_extract(head, rf"(?md)^{name}: ([^\r\n]*)", 1)

    kind, refers = value("WARC-Type"), F.regexp_extract(head, rf"(?md)^WARC-Refers-To: <{RECORD_ID}(-?\d+)>", 1)
    own = F.regexp_extract(head, rf"(?md)^WARC-Record-ID: <{RECORD_ID}(-?\d+)>", 1)
    digest, size = F.sha1("payload"), F.octet_length("payload").cast("long")
    declared = value("Content-Length").cast("long")
    sound = (F.concat(F.lit("sha1:"), digest) == value("WARC-Payload-Digest")) & (
        declared == http + F.when(kind == "revisit", F.lit(0)).otherwise(size)
    )
    return records.select(
        F.when(own != "", own).cast("long").alias("page_id"),
        F.when(sound, size).otherwise(F.raise_error(F.lit("a record does not match its header")).cast("long")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        kind.alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """WARC files of the records: header, payload unless a revisit, two line breaks.

    The text writer puts a line feed after each row, which is the last byte of a record's end.
    """
    revisit = F.substring_index(F.decode("header", "UTF-8"), END, 1).contains("\r\nWARC-Type: revisit\r\n")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    records.select(F.concat("header", body, F.lit(b"\r\n\r")).cast("string").alias("value")).write.option("lineSep", "\n").text(path)


SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
kept AS (SELECT page_id, body, strlen(body) AS size, max(page_id) OVER (PARTITION BY body) AS keeper FROM rows)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN size >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM kept
"""
