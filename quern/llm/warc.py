"""Content-addressed WARC archive: payload bytes once per verified strong digest, exact headers apart, records through joins.

`write_archive` stores two Parquet tables in the shared folder: `records` (one row per capture, with the exact
header block) and `payloads` (one row per digest). `read_records` joins them back into complete WARC/1.1 records, and
`read_archive` parses those and verifies every digest against the bytes.

Null payloads are empty payloads; null urls give an empty target; a record with a null page id is a response unless
a smaller non-null page id has its payload; captures repeated under the response's page id are responses too, under the
same record id; line ends in urls are left out;
payloads under `min_revisit_bytes` are always responses (their bytes are stored once all the same); an empty table
gives an empty archive; other columns are not read. Everything runs on built-in functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import hot_keys, join_hot, materialise, shared_dir

CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    records: str
    payloads: str


def _uri(page_id: F.Column) -> F.Column:
    """Ids of any text, percent-encoded, so that the brackets end them."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 100, date: str | F.Column = "2024-01-01T00:00:00Z") -> Archive:
    """Write every page as a record. Payload bytes cross the network only to reach their digest's one row.

    `date` is the capture time as WARC writes it, or a column of `pages` that holds it.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/quern-warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", F.col("url").alias("url"), (F.lit(date) if isinstance(date, str) else date).cast("string").alias("date"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("page_id", "url", "date", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("check"), "payload")
    slim = rows.drop("payload", "url", "date")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min("bytes").alias("b0"), F.max("bytes").alias("b1"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.count(F.lit(1)).alias("n"))
    # Equal digests must be equal bytes: length and a second hash agree over the whole group.
    first = first.select("digest", "first_id", F.assert_true((F.col("b0") == F.col("b1")) & (F.col("c0") == F.col("c1")), "two payloads share a digest").alias("ok"), "n").filter("ok is null").drop("ok")
    first = materialise(first, "first")
    joined = join_hot(rows.drop("check", "payload"), first.drop("n"), "digest", hot_keys(first, "digest"), ["page_id", "url"])
    response = (F.col("bytes") < min_revisit_bytes) | F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(response, "response").otherwise("revisit")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind,
        F.lit(CRLF + "WARC-Record-ID: "), _uri(F.col("page_id")),
        F.lit(CRLF + "WARC-Date: "), F.regexp_replace(F.coalesce("date", F.lit("")), "[\r\n]", ""), F.lit(CRLF + "WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", ""),
        F.lit(CRLF + "WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(~response, F.concat(F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), _uri(F.col("first_id")))).otherwise(""),
        F.lit(CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.when(response, F.col("bytes")).otherwise(0).cast("string"),
        F.lit(CRLF + CRLF),
    )
    joined.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/records")
    # Equal digests are equal bytes (asserted above), so any holder will do; copies meet map-side first.
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    return Archive(f"{path}/records", f"{path}/payloads")


def _field(header: F.Column, name: str, value: str = "[^\r\n]*") -> F.Column:
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ({value})", 1), F.lit(""))


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, record (WARC bytes) of every record. Only responses meet the payload table, so a payload that many
    captures share is read once. A response whose payload is missing raises."""
    records, payloads = spark.read.parquet(archive.records), spark.read.parquet(archive.payloads)
    text = F.decode("header", "UTF-8")
    wants = records.withColumn("want", F.when(_field(text, "WARC-Type") == "response", F.col("digest")))
    counts = materialise(wants.filter("want is not null").groupBy("want").agg(F.count(F.lit(1)).alias("n")), "wanted")
    rows = join_hot(wants, payloads.withColumnRenamed("digest", "want"), "want", hot_keys(counts, "want"), ["page_id", "header"], "left")
    body = F.when(F.col("want").isNull(), F.lit(b"")).otherwise(F.coalesce("payload", F.raise_error(F.lit("a payload is missing")).cast("binary")))
    return rows.select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to (page id as text), digest (as declared), body and body_ok (the record's bytes have the
    declared length and end, and a response's the declared digest), all from the WARC bytes in `record`."""
    at = F.expr("instr(decode(record, 'ISO-8859-1'), '\r\n\r\n')")  # one character a byte
    rows = records.withColumn("_head", F.expr("substring(record, 1, {0})".format("instr(decode(record, 'ISO-8859-1'), '\r\n\r\n') - 1")))
    head = F.decode("_head", "UTF-8")
    size = F.coalesce(_field(head, "Content-Length").cast("long"), F.lit(-1))
    rows = rows.select("page_id", "record", at.cast("int").alias("_at"), size.cast("int").alias("_n"), _field(head, "WARC-Type").alias("record_type"), _field(head, "WARC-Refers-To", "<urn:page:[^>]*>").alias("_to"), F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha256:", "").alias("digest"))
    rows = rows.withColumn("body", F.expr("substring(record, _at + 4, _n)"))
    whole = (F.octet_length("record") == F.col("_at") + 3 + F.col("_n") + 4) & (F.expr("substring(record, _at + 4 + _n, 4)") == F.lit(b"\r\n\r\n"))
    good = whole & ((F.col("record_type") != "response") | (F.sha2("body", 256) == F.col("digest")))
    return rows.select("page_id", "record_type", F.url_decode(F.regexp_extract("_to", "^<urn:page:([^>]*)>$", 1)).alias("refers_to"), "digest", "body", F.coalesce(good, F.lit(False)).alias("body_ok"))


def read_archive(spark: SparkSession, archive: Archive, with_payload: bool = False) -> DataFrame:
    """page_id, record_type, refers_to (page id as text), digest, payload_bytes of every capture, read back from the records.

    Lengths and digests are those of the responses' bytes, which revisits take by their digest. A record whose bytes are
    missing, altered or not as declared raises. `with_payload` adds the full payload, also of revisits.
    """
    parsed = parse_records(read_records(spark, archive))
    parsed = parsed.select("page_id", "record_type", "refers_to", F.when(F.col("body_ok"), F.col("digest")).otherwise(F.raise_error(F.lit("a record is damaged")).cast("string")).alias("digest"), F.octet_length("body").cast("long").alias("own_bytes"))
    parsed = materialise(parsed, "captures")
    held = parsed.groupBy("digest").agg(F.min(F.when(F.col("record_type") == "response", F.col("own_bytes"))).alias("payload_bytes"), F.count(F.lit(1)).alias("n"))
    held = materialise(held, "held")
    out = join_hot(parsed, held.drop("n"), "digest", hot_keys(held, "digest"), ["page_id"], "left").select("page_id", "record_type", "refers_to", "digest", F.coalesce("payload_bytes", F.raise_error(F.lit("a revisit has no response")).cast("long")).alias("payload_bytes"))
    return out.join(spark.read.parquet(archive.payloads), "digest") if with_payload else out
