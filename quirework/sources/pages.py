"""Readers and writers of page books: one row per page, in order within its book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType([T.StructField("book_id", T.StringType()), T.StructField("page_seq", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("content", T.StringType())])
PAGE_JSON = T.StructType([T.StructField("id", T.LongType()), T.StructField("content", T.StringType())])


def spread(table: DataFrame) -> DataFrame:
    """``table``, dealt out to all cores if its files have fewer splits than the session has cores.

    A small file of one row group is one task otherwise.  Larger inputs have more splits than cores and
    aren't shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def from_columns(df: DataFrame, book, order, page_id, content) -> DataFrame:
    """Pages of any table: ``book`` groups, ``order`` sorts within a book."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    seq = F.row_number().over(W.partitionBy(as_col(book)).orderBy(as_col(order)))
    return df.select(as_col(book).cast("string").alias("book_id"), seq.cast("long").alias("page_seq"), as_col(page_id).cast("long").alias("page_id"), F.coalesce(as_col(content), F.lit("")).alias("content"))


def read_json_books(spark: SparkSession, path: str) -> DataFrame:
    """Books of JSON files, each an array of pages or an object with ``pages``; the file's name is the book.

    A page must have an integer id and a text; a file that has others fails when it is read.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("book_id"), F.col("value"))
    listed = F.from_json("value", T.ArrayType(PAGE_JSON))
    nested = F.from_json("value", T.StructType([T.StructField("pages", T.ArrayType(PAGE_JSON))]))["pages"]
    pages = files.select("book_id", F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(nested)).alias("page_seq", "p"))
    wrong = F.raise_error(F.concat(F.lit("not a page in book "), F.col("book_id")))
    return pages.select("book_id", (F.col("page_seq") + 1).cast("long").alias("page_seq"), F.when(F.col("p.id").isNull() | F.col("p.content").isNull(), wrong.cast("long")).otherwise(F.col("p.id")).alias("page_id"), F.col("p.content").alias("content"))


def validate_book(pages: DataFrame) -> DataFrame:
    """(book_id, problem, page_id) for pages with no positive id, an id that repeats, or no text."""
    twice = F.count(F.lit(1)).over(W.partitionBy("book_id", "page_id")) > 1
    problem = F.when(F.col("page_id").isNull() | (F.col("page_id") <= 0), "id_not_positive").when(twice, "duplicate_id").when(F.coalesce(F.col("content"), F.lit("")) == "", "empty_content")
    return pages.select("book_id", problem.alias("problem"), "page_id").where("problem is not null")


def sample_pages(pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages whose (book_id, page_id) are in ``ids``, and the ids that no page has."""
    keys = ids.select("book_id", "page_id").distinct()
    return pages.join(keys, ["book_id", "page_id"], "left_semi").select(*pages.columns), keys.join(pages, ["book_id", "page_id"], "left_anti")


def pages_up_to(pages: DataFrame, last_id: int) -> DataFrame:
    return pages.where(F.col("page_id") <= last_id)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """RFC 4180: quoted fields, doubled quotes, line breaks within quotes."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def row_chunks(df: DataFrame, chunks: int, order: str) -> DataFrame:
    """``df`` with ``chunk``, 0 to ``chunks`` - 1: equal runs of rows in the order of ``order``.

    Row numbers come from a range partitioning and its partitions' counts, so no task sees all rows.
    """
    if chunks < 1:
        raise ValueError("chunks must be 1 or more")
    spread = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("qw_part", F.spark_partition_id())
    counted = spread.groupBy("qw_part").count()
    before = counted.select("qw_part", (F.sum("count").over(W.orderBy("qw_part")) - F.col("count")).alias("qw_before"))  # a row for each partition
    total = counted.agg(F.sum("count").alias("qw_total"))
    number = F.col("qw_before") + F.row_number().over(W.partitionBy("qw_part").orderBy(order)) - 1
    out = spread.join(F.broadcast(before), "qw_part").crossJoin(F.broadcast(total))
    return out.withColumn("chunk", F.floor(number / F.ceil(F.col("qw_total") / chunks)).cast("int")).drop("qw_part", "qw_before", "qw_total")


def chunk_manifest(chunked: DataFrame, order: str) -> DataFrame:
    """chunk, rows, first, last."""
    return chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))


def segments_csv(segments: DataFrame) -> DataFrame:
    """Segments as one-line rows: i, from, to, k (kind), l (lemma), t (text, with line breaks as ``\\n``)."""
    meta = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    return segments.select(F.col("seg_seq").alias("i"), F.col("from_id").alias("from"), F.col("to_id").alias("to"), meta("kind").alias("k"), meta("lemma").alias("l"), F.regexp_replace("content", "\n", r"\\n").alias("t"))


def write_segments_csv(segments: DataFrame, path: str) -> None:
    segments_csv(segments).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def preview_html(title: str, segments: list[dict]) -> str:
    """A searchable table of a few segments, for a browser."""
    from html import escape

    kinds: dict[str, int] = {}
    for s in segments:
        kind = (s.get("meta") or {}).get("kind", "-")
        kinds[kind] = kinds.get(kind, 0) + 1
    stats = " ".join(f"<b>{escape(k)}</b> {n}" for k, n in sorted(kinds.items()))
    rows = "".join(f"<tr><td>{s['from_id']}<td>{s.get('to_id') or ''}<td>{escape((s.get('meta') or {}).get('lemma', ''))}<td dir=auto>{escape(s['content'])}" for s in segments)
    find = "for(const r of document.querySelectorAll('tr'))r.hidden=!r.textContent.includes(this.value)"
    return f'<!doctype html><meta charset=utf-8><title>{escape(title)}</title><p>{len(segments)} segments {stats}<p><input placeholder=Search oninput="{find}"><table>{rows}</table>'
