"""A content-addressed web archive: payloads once by digest, record headers as they are, records by joins.

An archive is a folder of two tables. ``payloads`` holds the bytes of each distinct
payload once under its SHA-256; ``headers`` holds for each record its exact header
bytes (the WARC fields and, for responses, the HTTP head) and the digest of its
payload. A record is its header, its payload and two line ends, so joining the tables
on the digest gives each record back byte by byte, and reading an archive hashes each
stored payload again: what doesn't match its digest isn't given out.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest
page_id is the response and the others are revisits that refer to it; smaller payloads
are all responses. Equal page_ids are told apart by url, then by row.

Payload bytes are read where they lie: digests, choices and headers are worked out on
narrow rows, only the chosen copies of payloads are moved, once, and digests that hold
more than 1/4096 of the pages meet their choice by a broadcast of fewer than 4096 rows.

``write_files`` writes an archive as WARC files, ``read_files`` cuts such files into
records by their declared lengths.

Cases: null html is an empty payload; a null page_id counts as smaller than any other
and is null on reading (so is refers_to, where the response has none); a null url gives
no target field, line ends in a url are percent-encoded; repeated rows make a record
each, one of them the response; an empty table gives an empty archive; other columns
are ignored; bytes that aren't UTF-8 are kept. Payloads are single values of a column,
so at most 2 GB.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import joined, large_keys
from .storage import materialize, shared_dir, small_batches

#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD = "WARC-X-Page-ID"
#: The instant that records bear where the pages tell none.
DATE = "2000-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """An archive's folder; its tables are read on demand."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def base32_of_hex(hexadecimal: Column) -> Column:
    """RFC 4648 base 32 of a SHA-1 in hexadecimal: each 10 digits (40 bits) are 8 digits."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha256(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _urn(hexadecimal: Column) -> Column:
    """A record's id from 32 hexadecimal digits."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexadecimal, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _bytes(column: str) -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def _headers(facts: DataFrame, chosen: DataFrame, large: DataFrame, min_bytes: int, date: str) -> DataFrame:
    """(header, digest) of each record: which one is the response is in ``chosen``."""
    known = joined(facts, chosen, ["digest"], large)
    revisit = (F.col("n") >= min_bytes) & (F.col("uid") != F.col("top.uid"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    warc = F.concat(
        F.lit(VERSION + END),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("record"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")),
        _field(PAGE_FIELD, F.col("page_id").cast("string")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        _field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("top.record")))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
    )
    return known.select(F.concat(warc, F.lit(END), http).cast("binary").alias("header"), "digest")


def write_archive(pages: DataFrame, min_bytes: int = 0, date: str = DATE) -> Archive:
    """A record for each page (page_id, url, html), written to the shared folder."""
    spark = pages.sparkSession
    payload = _bytes("html")
    facts = pages.select("page_id", F.col("url").cast("string").alias("url"), sha256(payload).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n")).withColumn("uid", F.monotonically_increasing_id())
    facts = materialize(facts.withColumn("record", F.md5(F.to_json(F.struct("page_id", "url", F.hex("digest"), "uid")))), "warc-facts")
    # equal (digest, page_id) first, so that what is left of a digest is one row for each page
    pairs = facts.groupBy("digest", "page_id").agg(F.max(F.struct("url", "uid", "record")).alias("top"), F.count("*").alias("c"))
    digests = materialize(pairs.groupBy("digest").agg(F.max(F.struct("page_id", "top")).alias("best"), F.sum("c").alias("c")), "warc-digests")
    large = large_keys(digests, ["digest"], "c")
    chosen = digests.select("digest", F.col("best.top").alias("top"))
    path = f"{shared_dir(spark)}/girder/warc-{uuid.uuid4().hex}"
    _headers(facts, chosen, large, min_bytes, date).write.parquet(f"{path}/headers")
    # one copy of each payload: only rows of the chosen page are candidates, equal ones collapse
    copies = pages.select("page_id", payload.alias("payload")).withColumn("digest", sha256(F.col("payload")))
    holders = digests.select("digest", F.col("best.page_id").alias("holder"))
    # no equality of columns to Spark, so the join's key is the digest alone and its partitions serve the aggregate too
    mine = F.when(F.col("page_id").isNull(), F.col("holder").isNull()).otherwise(F.coalesce(F.col("page_id") == F.col("holder"), F.lit(False)))
    often = copies.join(F.broadcast(holders.join(F.broadcast(large), "digest", "left_semi")), "digest").filter(mine)
    rare = copies.join(F.broadcast(large), "digest", "left_anti").join(holders.hint("shuffle_hash"), "digest").filter(mine)  # the narrow side is hashed, payloads aren't sorted
    once = [x.groupBy("digest").agg(F.first("payload").alias("payload")) for x in (often, rare)]
    once[0].unionByName(once[1]).write.parquet(f"{path}/payloads")
    return Archive(spark, path)


def field(header: Column, name: str) -> Column:
    """A field of the WARC head (not of the HTTP head after it), null where it is absent."""
    head = F.substring_index(header.cast("string"), END + END, 1)
    found = F.regexp_extract(head, rf"(?i)\r\n{re.escape(name)}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from its header and its verified payload; a payload that doesn't match its digest gives nulls."""
    h = F.col("header")
    records = archive.table("headers").select(
        "digest", field(h, PAGE_FIELD).cast("long").alias("page_id"), field(h, "WARC-Type").alias("record_type"), field(h, "WARC-Record-ID").alias("record"), field(h, "WARC-Refers-To").alias("refers"), field(h, "WARC-Payload-Digest").alias("said")
    )
    payload = F.col("payload")
    stored = archive.table("payloads").select("digest", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_of_hex(F.sha1(payload)).alias("payload_digest"), (sha256(payload) == F.col("digest")).alias("sound"))
    stored = materialize(stored.filter("sound").drop("sound"), "warc-stored")
    per_digest = materialize(records.groupBy("digest").agg(F.max(F.when(F.col("record_type") == "response", F.struct("page_id", "record"))).alias("top"), F.count("*").alias("c")), "warc-records")
    few = per_digest.join(stored, "digest", "left").select("digest", "top", "payload_bytes", "payload_digest")
    known = joined(records, few, ["digest"], large_keys(per_digest, ["digest"], "c"))
    agrees = F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    refers = F.when((F.col("record_type") == "revisit") & (F.col("refers") == F.col("top.record")), F.col("top.page_id"))
    return known.select("page_id", F.when(agrees, F.col("payload_bytes")).alias("payload_bytes"), F.when(agrees, F.col("payload_digest")).alias("payload_digest"), "record_type", refers.alias("refers_to"))


def reconstruct(archive: Archive) -> DataFrame:
    """(page_id, record): the bytes of each record without the two line ends after it. Responses meet their payload, revisits are their header."""
    headers = archive.table("headers").withColumn("response", field(F.col("header"), "WARC-Type") == "response")
    whole = archive.table("payloads").join(headers.filter("response").hint("shuffle_hash"), "digest").select("header", F.concat("header", "payload").alias("record"))
    return whole.unionByName(headers.filter(~F.col("response")).select("header", F.col("header").alias("record"))).select(field(F.col("header"), PAGE_FIELD).cast("long").alias("page_id"), "record")


def write_files(archive: Archive, folder: str, records_a_file: int = 10_000) -> None:
    """The archive as WARC files, one or more for each task."""
    text = reconstruct(archive).select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END + END).option("maxRecordsPerFile", records_a_file).text(folder)


_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)")


def _records(content: memoryview) -> Iterator[tuple[int, int, int, str | None]]:
    """(start, start of the payload, end, error) of each record of a file. After an error nothing more of the file is read."""
    at = 0
    while at < len(content):
        head_end = bytes(content[at : at + 65536]).find(b"\r\n\r\n")
        length = _LENGTH.search(bytes(content[at : at + head_end + 2])) if head_end >= 0 else None
        if bytes(content[at : at + 5]) != b"WARC/" or length is None:
            yield at, len(content), len(content), "no record head"
            return
        block = at + head_end + 4
        end = block + int(length[1])
        if end > len(content):
            yield at, len(content), len(content), "record is cut off"
            return
        http = bytes(content[block : min(block + 65536, end)])
        skip = http.find(b"\r\n\r\n") + 4 if http.startswith(b"HTTP/") else 0
        yield at, block + (skip if skip >= 4 else 0), end, None
        at = end + 4


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            content = memoryview(batch.column("content")[i].as_buffer())
            for start, payload, end, error in _records(content):
                columns = [[batch.column("path")[i].as_py()], [start], [bytes(content[start:payload])], [bytes(content[payload:end])], [error]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()), strict=True)], ["path", "start", "header", "payload", "error"])


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, start, header, payload, error) of each record of the WARC files of a folder, cut by declared lengths; a damaged record has an error and ends its file."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
    return files.mapInArrow(_split, "path string, start long, header binary, payload binary, error string")


def store_records(records: DataFrame) -> Archive:
    """An archive of records as they are (header, payload): headers stay byte by byte, payloads are stored once."""
    spark = records.sparkSession
    path = f"{shared_dir(spark)}/girder/warc-{uuid.uuid4().hex}"
    kept = records.select(F.col("header").cast("binary").alias("header"), _bytes("payload").alias("payload")).withColumn("digest", sha256(F.col("payload")))
    kept.select("header", "digest").write.parquet(f"{path}/headers")
    kept.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    return Archive(spark, path)
