"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder.  ``payloads`` holds each payload's bytes
once, under the SHA-256 of the bytes; ``records`` holds the exact header block of every
WARC record and the digest of the payload it stands for.  Records are rebuilt by a join.
Everything runs on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Digits of Spark's conv() in base 32, and the base32 alphabet of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value: profile of revisit records in WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32 (160 bits are exactly 32 digits, 8 from each 5 bytes)."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record for every row of ``pages`` (``page_id, url, html``) to ``path``.

    The payload is ``html`` in UTF-8, null as empty.  Among records with equal payloads of at
    least ``min_revisit_bytes`` bytes the one with the smallest ``page_id`` is a response
    and the others revisit it; null ids come last, and of repeated rows one is the
    response.  Smaller payloads are all responses.  Null urls and ids leave their header field out.
    Other columns are ignored; an empty table gives an archive without records.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("string").alias("page"), F.col("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # the bytes are shuffled once, each payload at most once a map task
    base.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    # what follows moves digests and ids alone; row numbers are settled by writing them
    index = base.select("page", "page_id", "url", "digest", F.octet_length("payload").cast("long").alias("length"), base32_sha1(F.col("payload")).alias("sha1"))
    index.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/index")
    slim = pages.sparkSession.read.parquet(f"{path}/index")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    lead = slim.groupBy("digest").agg(F.min(order).alias("lead"))
    joined = slim.join(lead, "digest")
    response = (F.col("row") == F.col("lead.row")) | (F.col("length") < min_revisit_bytes)
    identity = lambda page, row: F.concat(F.coalesce(F.concat(F.lit("<urn:page:"), page.cast("string")), F.concat(F.lit("<urn:row:"), row.cast("string"))), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _field("WARC-Record-ID", identity(F.col("page"), F.col("row"))),
        F.when(F.col("url").isNotNull(), _field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " "))).otherwise(""),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, "").otherwise(F.concat(_field("WARC-Refers-To", identity(F.col("lead.page_id"), F.col("lead.row"))), _field("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(response, F.col("length")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    )
    joined.select(header.alias("header"), "digest").write.parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``digest, payload`` of an archive; bytes that do not have their digest raise an error."""
    raw = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    return raw.select("digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its digest says: "), F.col("digest")))).alias("payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``header, digest`` of every record of an archive."""
    return spark.read.schema("header string, digest string").parquet(f"{path}/records")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild every record: ``header, payload`` (the full payload, for revisits too) and ``record``, the exact WARC bytes."""
    whole = read_headers(spark, path).join(read_payloads(spark, path), "digest")
    block = F.when(F.col("header").contains(f"{CRLF}WARC-Type: revisit{CRLF}"), F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("header", "payload", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def check_records(spark: SparkSession, path: str) -> DataFrame:
    """``header, payload_bytes, payload_digest, record_bytes`` of every record, measured on the records as they are rebuilt.

    A response is rebuilt by joining its payload, which crosses the network once, and must have the length and digest that its
    header states, else an error is raised.  A revisit's block is empty; its payload's figures are those of the stored payload, and only
    they are joined to it.
    """
    headers = read_headers(spark, path)
    payloads = read_payloads(spark, path)
    is_revisit = F.col("header").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    length, sha1 = F.octet_length("payload").cast("long"), base32_sha1(F.col("payload"))
    rebuilt = headers.where(~is_revisit).join(payloads, "digest")
    rebuilt = rebuilt.select("header", length.alias("payload_bytes"), sha1.alias("payload_digest"), F.octet_length(F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.lit(b"\r\n\r\n"))).cast("long").alias("record_bytes"))
    sound = (header_field("Content-Length") == F.col("payload_bytes").cast("string")) & (header_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    wrong = F.raise_error(F.concat(F.lit("record is not what its header says: "), F.col("header")))
    rebuilt = rebuilt.withColumn("payload_bytes", F.when(F.coalesce(sound, F.lit(False)), F.col("payload_bytes")).otherwise(wrong))
    measured = payloads.select("digest", length.alias("payload_bytes"), sha1.alias("payload_digest"))
    revisits = headers.where(is_revisit).join(measured, "digest").select("header", "payload_bytes", "payload_digest", (F.octet_length(F.encode("header", "UTF-8")) + 4).cast("long").alias("record_bytes"))
    return rebuilt.unionByName(revisits)


def header_field(name: str) -> Column:
    """A field of a record's header block, null if it is not there."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").contains(f"{CRLF}{name}: "), found)


def page_of(name: str) -> Column:
    """The page id in a record-id field, as text; null for a record of a page without id."""
    found = F.regexp_extract(header_field(name), r"^<urn:page:(.*)>$", 1)
    return F.when(header_field(name).startswith("<urn:page:"), found)
