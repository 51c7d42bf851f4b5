"""Page-local operators over streams of pages: what needs no other page works on each as it arrives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect_tokens
from ..operators.layout import lines, prepared


def read_pages(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive under ``path``."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def detected(pages: DataFrame, transforms: tuple = ()) -> DataFrame:
    """Preprocessed pages with their tokens; stateless, so any sink and output mode will do."""
    return detect_tokens(prepared(pages, transforms))


def line_starts(pages: DataFrame) -> DataFrame:
    """start, count: how many lines open with each word; state is a row for each word."""
    first = F.regexp_extract("line", r"^([^\s]+)", 1)
    return lines(prepared(pages)).select(first.alias("start")).where("start <> ''").groupBy("start").agg(F.count(F.lit(1)).alias("count"))


def windowed_pages(pages: DataFrame, time: str | Column, width: str, late: str) -> DataFrame:
    """Pages and characters by time window; rows later than ``late`` behind the newest are dropped with their state."""
    return pages.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("content")).alias("characters"))


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quirework-stream-")
    return f"{named}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str) -> StreamingQuery:
    """Write all that is there now, as Parquet with a checkpoint, and stop: exactly once after failures, too."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def count_line_starts(spark: SparkSession, path: str) -> DataFrame:
    """Line starts of a table of documents, read as a stream and written batch by batch, then summed."""
    folder = _folder(spark)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a file or a folder
    one = F.lit(1).cast("long")
    pages = stream.where("text is not null").select(F.col("doc_id").cast("string").alias("book_id"), one.alias("page_seq"), F.col("doc_id").cast("long").alias("page_id"), F.col("text").alias("content"))
    starts = lines(prepared(pages)).select(F.regexp_extract("line", r"^([^\s]+)", 1).alias("start")).where("start <> ''")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("start").agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    starts.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("start").agg(F.sum("count").alias("count"))
