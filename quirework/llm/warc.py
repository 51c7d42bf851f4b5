"""Content-addressed web archive: payload bytes once, exact record headers apart, records by join.

``archive`` splits records into ``headers`` (record id, the header's exact bytes, digest and length of the
payload) and ``blobs`` (digest, payload), with SHA-256 as the address.  ``write_archive`` adds both to a folder,
payloads that are there already not again.  ``restore`` joins them and verifies every payload against its
address and length, so a damaged blob shows instead of spreading; ``write_warc`` writes restored records as
WARC files and ``read_warc`` reads such files, one record at a time.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record_id bigint, header binary, payload binary"
END = "\r\n\r\n"
#: The date of records whose source has none.
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes that a reader holds before it passes records on.
HELD = 8 << 20


def page_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Each page as a WARC resource record: record_id, header (with its empty line), payload.

    A null url or page_id leaves its header field out; a null html is an empty payload; line ends within a
    url are written as %0D and %0A, so that they can't end the field.  ``date``: when the pages were
    fetched, which the table doesn't say.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END),
    )
    return pages.select(F.col("page_id").cast("long").alias("record_id"), header.cast("binary").alias("header"), payload.alias("payload"))


def digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def archive(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, blobs) of ``records``.

    headers: record_id, header, payload_digest, payload_bytes; no payload is shuffled for it.  blobs:
    payload_digest, payload, one row per digest; the aggregate combines on the map side, so a task sends a
    payload once however many records repeat it, and the result is partitioned by digest, as
    ``restore`` needs it.
    """
    full = records.select("record_id", "header", F.coalesce("payload", F.lit(b"")).alias("payload"))
    full = full.withColumn("payload_digest", digest(F.col("payload")))
    headers = full.select("record_id", "header", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return headers, full.groupBy("payload_digest").agg(F.first("payload").alias("payload"))


def restore(headers: DataFrame, blobs: DataFrame) -> DataFrame:
    """record_id, payload_digest, payload_bytes, record (header, payload, two line ends), verified.

    A header whose blob is missing keeps its row, with a null record and ``verified`` false.
    """
    checked = blobs.select("payload_digest", "payload", (digest(F.col("payload")) == F.col("payload_digest")).alias("sound"))
    joined = headers.join(checked, "payload_digest", "left")
    verified = F.coalesce(F.col("sound") & (F.octet_length("payload") == F.col("payload_bytes")), F.lit(False))
    record = F.concat("header", "payload", F.lit(END.encode()))
    return joined.select("record_id", "payload_digest", "payload_bytes", record.alias("record"), verified.alias("verified"))


def write_archive(records: DataFrame, folder: str) -> None:
    """Add ``records`` to the archive in ``folder`` (Parquet: headers, blobs); a payload that it has isn't written again.

    Blobs go first, so a job that is lost between the two leaves no header without its payload.
    """
    spark = records.sparkSession
    headers, blobs = archive(records)
    try:
        blobs = blobs.join(spark.read.parquet(f"{folder}/blobs").select("payload_digest"), "payload_digest", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # nothing there yet
            raise
    blobs.write.mode("append").parquet(f"{folder}/blobs")
    headers.write.mode("append").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(headers, blobs) of the archive in ``folder``; a blob that two writers added at once counts once."""
    blobs = spark.read.parquet(f"{folder}/blobs").groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    return spark.read.parquet(f"{folder}/headers"), blobs


def write_warc(restored: DataFrame, folder: str) -> DataFrame:
    """Write verified records as ``part-N.warc.gz``, a gzip member each; returns the manifest (file, records, bytes).

    A task writes under a name of its own attempt and then renames, so a lost executor leaves whole files.
    Records that aren't verified are left out: they have no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        records = size = 0
        with system.open_output_stream(f"{name}.{context.taskAttemptId()}", compression=None) as out:
            for batch in batches:
                for record in batch.column(0):
                    data = record.as_py()
                    out.write(gzip.compress(data, mtime=0))
                    records, size = records + 1, size + len(data)
        system.move(f"{name}.{context.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return restored.where("verified").select("record").mapInArrow(run, "file string, records long, bytes long")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Every page archived and restored: page_id, payload_digest, payload_bytes, record (as text), verified.

    Defined cases: null html is an empty payload; null url and page_id leave out their header fields;
    repeated rows and equal payloads share one blob and are all restored; other columns are not read.
    """
    out = restore(*archive(page_records(pages)))
    return out.select(F.col("record_id").alias("page_id"), "payload_digest", "payload_bytes", F.col("record").cast("string").alias("record"), "verified")


def oracle() -> str:
    end = "chr(13) || chr(10)"
    return f"""
SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
  'WARC/1.1' || {end} || 'WARC-Type: resource' || {end}
  || coalesce('WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || {end}, '')
  || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || {end}, '') || 'WARC-Date: {DATE}' || {end}
  || 'Content-Type: text/html; charset=utf-8' || {end} || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
  || {end} || {end} || coalesce(html, '') || {end} || {end} AS record, true AS verified
FROM pages"""


LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.IGNORECASE)


def parse_records(stream: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """(header with its empty line, payload) of each record of a WARC stream, plain or in gzip members; a record at a time."""
    stream = io.BufferedReader(stream)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while True:
        header = b""
        while not header.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                if header.strip():
                    raise ValueError("the file ends within a header")
                return
            if header or line.strip():
                header += line
        found = LENGTH.search(header)
        if not header.startswith(b"WARC/") or not found:
            raise ValueError(f"not a WARC header: {header[:40]!r}")
        payload = stream.read(int(found[1]))
        if len(payload) < int(found[1]):
            raise ValueError("the file ends within a payload")
        yield header, payload


def read_warc(files: DataFrame) -> DataFrame:
    """Records of the WARC files that ``files`` names in ``path``; record_id is a hash of path and place.

    Only paths are read by Spark (of ``spark.read.format("binaryFile")``, too); a worker opens each file and passes
    records on as they come, so a file of any size takes one record's memory and ``HELD`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def rows(ids: list, headers: list, payloads: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(headers, pa.binary()), pa.array(payloads, pa.binary())], ["record_id", "header", "payload"])

        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")
                ids, headers, payloads, held = [], [], [], 0
                with system.open_input_file(name) as stream:
                    for k, (header, payload) in enumerate(parse_records(stream)):
                        ids.append(number + k)
                        headers.append(header)
                        payloads.append(payload)
                        held += len(payload)
                        if held >= HELD:
                            yield rows(ids, headers, payloads)
                            ids, headers, payloads, held = [], [], [], 0
                yield rows(ids, headers, payloads)

    start = F.shiftright(F.xxhash64("path"), 1)  # room to count on from
    return files.select(start.alias("start"), "path").mapInArrow(run, RECORD)
