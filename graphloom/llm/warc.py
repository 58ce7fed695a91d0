"""Content-addressed WARC archive.

`write_archive` splits records into two tables in a folder: `payloads` (address, payload: each distinct payload once) and
`headers` (one row per record with its exact header block). The address is the strong digest SHA-256 of the payload; the WARC
header carries the usual base32 SHA-1. `read_records` checks each stored payload against its address and joins it to the headers
that have it as their block, which gives the exact bytes of every record. `parse_records` reads those bytes, `restore` follows
revisits to their responses, and `export_warc` writes the records as WARC files, a gzip member each.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import cut, join_by_weight, new_path

#: The digits of conv() and the letters of base32 in the same order: fixed values.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MIN_REVISIT = 0
NL = "\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The time of capture, where a table has none.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def record_id(*parts: Column) -> Column:
    d = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _header(refers: Column) -> Column:
    """The header block of a record with its closing empty line, after which a response has its payload and a revisit nothing.

    A null page_id or url has no line. Line ends of a url, which no URI may hold, are percent-encoded.
    """
    revisit = F.col("record_type") == "revisit"
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(NL)), F.lit(""))
    return F.concat(
        F.lit(VERSION + NL),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", refers))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(NL),
    )


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive of pages (page_id, url, html) to path.

    Of records with equal payloads of at least min_revisit bytes, the one with the largest page_id (a null id counts as
    smallest) is the response and the others revisit it; smaller payloads are all responses. Null html is an empty payload,
    repeated rows with the largest id are all responses; each row is a record with an id of its own. An empty table gives an empty
    archive. Other columns of pages are not kept.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("address", F.unhex(F.sha2("payload", 256)))
    rows.groupBy("address").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    # Rows are numbered, and written so that the numbers stand: rows that are alike in all columns have records of their own.
    numbered = rows.select("page_id", "url", "address", F.monotonically_increasing_id().alias("number"), base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    numbered = cut(numbered.withColumn("record_id", record_id(F.col("page_id"), F.col("url"), F.hex("address"), F.col("number"))), "records")
    first = cut(numbered.groupBy("address").agg(F.max(F.struct("page_id", "number", "record_id")).alias("first"), F.count("*").alias("n")), "responses")
    # A payload of many pages would gather in one task of a shuffle: there are few such payloads, which are broadcast.
    joined = join_by_weight(numbered, first, "address", "n", numbered.count())
    refers = (F.col("payload_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    headers = joined.withColumn("record_type", F.when(refers, "revisit").otherwise("response"))
    headers.select("address", "record_type", _header(F.col("first.record_id")).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


HEADERS, PAYLOADS = "address binary, record_type string, header string", "address binary, payload binary"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload) of each stored payload; fails if one does not hash to its address."""
    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("address")
    return stored.select(F.when(sound, F.col("address")).otherwise(F.raise_error(F.lit("a stored payload does not match its address")).cast("binary")).alias("address"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the exact bytes of each record of the archive at path; only responses are joined with payloads."""
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    end = F.lit(NL + NL).cast("binary")
    responses = headers.where("record_type = 'response'").join(read_payloads(spark, path), "address")
    revisits = headers.where("record_type <> 'response'").select(F.concat(F.col("header").cast("binary"), end).alias("record"))
    return responses.select(F.concat(F.col("header").cast("binary"), "payload", end).alias("record")).unionByName(revisits)


def parse_records(records: DataFrame) -> DataFrame:
    """(record_type, record_id, refers_id, page_id, url, digest, block) of records, from nothing but their bytes."""
    # The bytes of a header block are UTF-8; it ends with the first empty line. Only a line feed ends a line here (the flag d): a url may
    # hold what else ends lines in Unicode.
    head = F.substring_index(F.col("record").cast("string"), NL + NL, 1)
    parsed = records.select("record", head.alias("head"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?md)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))
    has = lambda name: F.contains("head", F.lit(f"{NL}{name}: "))
    size = field("Content-Length").cast("int")
    begin = F.octet_length("head") + 2 * len(NL)
    sound = F.startswith("head", F.lit(VERSION + NL)) & (F.octet_length("record") == begin + size + 2 * len(NL))
    return parsed.select(
        F.when(sound, field("WARC-Type")).otherwise(F.raise_error(F.lit("not a WARC record")).cast("string")).alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_id"),
        field("Page-ID").cast("long").alias("page_id"),
        F.when(has("WARC-Target-URI"), F.regexp_extract("head", r"(?md)^WARC-Target-URI: ([^\r\n]*)\r?$", 1)).alias("url"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        F.substring(F.col("record"), begin + 1, size).alias("block"),
    )


def restore(records: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the captures that records (record) stand for.

    What a response tells comes from its block, whose SHA-1 must be the one its header names; a revisit is joined to the response that
    it refers to, which must have the digest that the revisit names.
    """
    told = parse_records(records)
    digest = base32_sha1(F.col("block"))
    checked = lambda found, said, what: F.when(found == said, found).otherwise(F.raise_error(F.lit(what)).cast("string"))
    told = cut(
        told.select(
            "record_type", "record_id", "refers_id", "page_id", "url", "digest",
            F.octet_length("block").cast("long").alias("payload_bytes"),
            F.when(F.col("record_type") == "response", checked(digest, F.col("digest"), "a payload does not match its record's digest")).alias("payload_digest"),
        ),
        "told",
    )
    responses = told.where("record_type = 'response'").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = told.where("record_type = 'revisit'").select("page_id", "url", "digest", "record_type", "refers_id")
    counts = revisits.groupBy("refers_id").agg(F.count("*").alias("n"))
    of = told.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    found = join_by_weight(revisits, cut(of.join(counts, "refers_id"), "referred"), "refers_id", "n", revisits.count())
    same = checked(F.col("payload_digest"), F.col("digest"), "a revisit does not match its response")
    return responses.unionByName(found.select("page_id", "url", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to"))


def _info(name: str) -> bytes:
    body = f"format: WARC File Format 1.1{NL}".encode()
    lines = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return (NL.join(lines) + NL + NL).encode() + body + (NL + NL).encode()


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """Write the records of the archive at path as WARC files, one a partition: a warcinfo record, then each record, a gzip member each."""

    def members(batches):
        import uuid

        from pyspark import TaskContext

        name = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{path} {TaskContext.get().partitionId()}"))
        yield pa.RecordBatch.from_arrays([pa.array([member(_info(name))], pa.binary())], names=["member"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(x.as_py()) for x in batch["record"]], pa.binary())], names=["member"])

    def member(record: bytes) -> bytes:
        data = gzip.compress(record, mtime=0)
        # The writer ends each row with a zero byte. A member of a record under 16 MB ends with one, which it so gets back; after
        # others it is padding, which readers of gzip skip.
        return data[:-1] if data[-1] == 0 else data

    rows = read_records(spark, path).mapInArrow(members, "member binary")
    rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(to)


def archived_pages(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archive pages in the shared folder and read the records back: one row per page, all columns taken from the records' bytes.

    See write_archive for nulls, ties, repeated rows and empty tables.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archive")
    write_archive(pages, path, min_revisit)
    return restore(read_records(spark, path))
