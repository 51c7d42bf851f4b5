"""The archive: exact round trips of records and files, one blob per payload, damage that shows."""

import gzip
import io

from pyspark.sql import functions as F

from quirework.llm.warc import END, archive, archived_pages, page_records, parse_records, read_archive, read_warc, restore, write_archive, write_warc

PAGES = "page_id long, url string, html string"


def test_round_trip_and_defined_cases(spark):
    rows = [(1, "http://a.b/", "<p>x</p>"), (2, None, "<p>x</p>"), (None, "http://c.d/", None), (3, "http://e.f/", ""), (1, "http://a.b/", "<p>x</p>"), (4, "u", "é" * 300000)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(0) for c in ("header", "payload", "record_id", "payload_digest", "sound")})
    headers, blobs = archive(page_records(pages))
    assert headers.count() == 6 and blobs.count() == 3
    out = archived_pages(pages).collect()
    assert len(out) == 6 and all(r["verified"] for r in out)
    assert sorted(r["record"] for r in out) == sorted(r["header"].decode() + r["payload"].decode() + END for r in page_records(pages).collect())
    assert archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_and_loss_show(spark):
    headers, blobs = archive(page_records(spark.createDataFrame([(1, "u", "good"), (2, "v", "lost")], PAGES)))
    bad = blobs.where(F.col("payload") != F.lit(b"lost")).withColumn("payload", F.lit(b"evil"))
    got = {r["record_id"]: r for r in restore(headers, bad).collect()}
    assert not got[1]["verified"] and not got[2]["verified"] and got[2]["record"] is None


def test_files(spark, tmp_path):
    records = [(b"WARC/1.0\r\nContent-Length: 3\r\nX: 1\r\n\r\n", b"abc"), (b"WARC/1.0\r\ncontent-length: 0\r\n\r\n", b""), (b"WARC/1.0\r\nContent-Length: 4\r\n\r\n", b"\r\n\r\n")]
    plain = b"".join(h + p + END.encode() for h, p in records)
    zipped = b"".join(gzip.compress(h + p + END.encode()) for h, p in records)
    assert list(parse_records(io.BytesIO(plain))) == records == list(parse_records(io.BytesIO(zipped)))
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(zipped)
    got = read_warc(spark.read.format("binaryFile").load(str(tmp_path)))
    whole = restore(*archive(got))
    assert sorted(bytes(r["record"]) for r in whole.collect()) == sorted(2 * [h + p + END.encode() for h, p in records])


def test_archive_folder_and_written_files(spark, tmp_path):
    first = page_records(spark.createDataFrame([(1, "http://a/\r\nX: evil", "same"), (2, "http://b/", "same"), (3, None, "other")], PAGES))
    second = page_records(spark.createDataFrame([(4, "http://c/", "same"), (5, "http://d/", "new")], PAGES))
    folder = str(tmp_path / "archive")
    write_archive(first, folder)
    write_archive(second, folder)
    assert spark.read.parquet(f"{folder}/blobs").count() == 3 and spark.read.parquet(f"{folder}/headers").count() == 5
    whole = restore(*read_archive(spark, folder))
    manifest = write_warc(whole, str(tmp_path / "files")).collect()
    assert sum(r["records"] for r in manifest) == 5
    back = read_warc(spark.createDataFrame([(r["file"],) for r in manifest], "path string")).collect()
    assert sorted(bytes(r["header"]) + bytes(r["payload"]) for r in back) == sorted(bytes(r["header"]) + bytes(r["payload"]) for r in first.union(second).collect())
    evil = next(bytes(r["header"]).decode() for r in back if b"/a/" in bytes(r["header"]))
    assert "WARC-Target-URI: http://a/%0D%0AX: evil\r\n" in evil and "WARC-Date: " in evil
