"""The archive against hashlib, exact round trips of records and files, damage and hot payloads."""

import base64
import hashlib

from pyspark.sql import functions as F

from girder.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows, min_bytes=0):
    out, best = [], {}
    for i, (page, url, html, *_) in enumerate(rows):
        raw = (html or "").encode()
        key = (page is not None, page or 0, url is not None, url or "", i)
        best[raw] = max(best.get(raw, key), key)
    for i, (page, url, html, *_) in enumerate(rows):
        raw = (html or "").encode()
        revisit = len(raw) >= min_bytes and best[raw][4] != i
        top = best[raw][1] if best[raw][0] else None
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ROWS = [(1, "u", "a", "x"), (2, "v", "a", "x"), (2, "v", "a", "x"), (3, None, None, None), (4, "w\r\nX: y", "", "x"), (None, "z", "b", "x"), (None, None, None, None), (5, "ü", "é\r\n\r\nWARC/1.1\r\n", "x"), (6, "u", "y" * 2_000_000, "x"), (7, "u", "a", "x"), (8, "u", "only", "x"), (9, "u", "b", "x")]


def test_rows(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    for least in (0, 2):
        assert got(warc.read_archive(warc.write_archive(pages, least))) == sorted(brute(ROWS, least), key=repr)
    empty = warc.write_archive(pages.filter("page_id > 100"))
    assert warc.read_archive(empty).count() == 0 and warc.reconstruct(empty).count() == 0


def test_payloads_are_stored_once(spark):
    many = [(i, f"u{i}", "hot" if i % 3 == 0 else f"p{i % 50}", None) for i in range(900)]
    archive = warc.write_archive(spark.createDataFrame(many, SCHEMA))
    assert archive.table("payloads").count() == len({r[2] for r in many})
    assert archive.table("headers").count() == len(many)
    assert got(warc.read_archive(archive)) == sorted(brute(many), key=repr)


def test_files_and_records_round_trip(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame(ROWS, SCHEMA))
    warc.write_files(archive, str(tmp_path / "files"), 3)
    records = warc.read_files(spark, str(tmp_path / "files"))
    assert records.filter("error is not null").count() == 0
    wanted = sorted(bytes(r["record"]) for r in warc.reconstruct(archive).collect())
    assert sorted(bytes(r["header"]) + bytes(r["payload"]) for r in records.collect()) == wanted
    assert all(int(r.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0]) == len(r) - r.index(b"\r\n\r\n") - 4 for r in wanted)
    again = warc.store_records(records)
    assert sorted(bytes(r["header"]) for r in again.table("headers").collect()) == sorted(bytes(r["header"]) for r in archive.table("headers").collect())
    responses = lambda a: sorted(bytes(r["record"]) for r in warc.reconstruct(a).collect())
    assert responses(again) == wanted


def test_damage_is_told(spark, tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n"
    for name, data in (("a", head + b"abc\r\n\r\n" + head + b"ab"), ("b", b"not a record"), ("c", b""), ("d", head.replace(b"3", b"x") + b"abc\r\n\r\n")):
        (tmp_path / f"{name}.txt").write_bytes(data)
    found = sorted((r["path"][-5:], r["start"], bytes(r["payload"]), r["error"]) for r in warc.read_files(spark, str(tmp_path)).collect())
    assert found == [("a.txt", 0, b"abc", None), ("a.txt", len(head) + 7, b"", "record is cut off"), ("b.txt", 0, b"", "no record head"), ("d.txt", 0, b"", "no record head")]


def test_a_changed_payload_is_not_given_out(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS, SCHEMA))
    bad = archive.table("payloads").withColumn("payload", F.when(F.col("payload") == F.lit(b"a"), F.lit(b"A")).otherwise(F.col("payload")))
    copy = warc.Archive(spark, archive.path + "-changed")
    bad.write.parquet(f"{copy.path}/payloads")
    archive.table("headers").write.parquet(f"{copy.path}/headers")
    rows = warc.read_archive(copy).collect()
    assert sorted(r["page_id"] for r in rows if r["payload_digest"] is None) == [1, 2, 2, 7]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    assert got(queries.QUERIES["op12_warc_archive"](spark, sf)) == sorted(brute(rows), key=repr)
