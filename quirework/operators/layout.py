"""Pages of books as offsets and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

BOOK = ["book_id"]


def prepared(pages: DataFrame, transforms: tuple = ()) -> DataFrame:
    """Preprocessed pages with ``\\n`` line ends; narrow."""
    content = X.normalize_line_endings(X.preprocess("content", "page_id", list(transforms)))
    return pages.select("book_id", "page_seq", "page_id", content.alias("content"))


def by_book(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with each book's in one task, one after the other: what a worker needs that goes from book to book."""
    return rows.repartition("book_id").sortWithinPartitions("book_id", *order)


#: Rows and characters that a worker gathers before it sends them.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22


def batched(rows: Iterable[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of bounded size; ``text`` is the place of their longest column."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: Rows and bytes of a batch that a worker turns into Python's objects at once.
PART_ROWS, PART_BYTES = 512, 1 << 22


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches``, so that what is made of their rows is small however many come at once."""
    for batch in batches:
        step = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def books(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, Iterator[tuple]]]:
    """Each book_id with its rows, as they come: no more than a part of a batch is held."""
    rows = (row for part in parts(batches) for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
    return groupby(rows, itemgetter(0))


def page_offsets(pages: DataFrame) -> DataFrame:
    """book_id, page_seq, page_id, start, end of each page in the book joined by line breaks.

    ``end`` counts the page's line break too.  Only lengths are shuffled.
    """
    size = pages.select("book_id", "page_seq", "page_id", F.length("content").cast("long").alias("size"))
    before = F.sum(F.col("size") + 1).over(W.partitionBy("book_id").orderBy("page_seq")) - F.col("size") - 1
    return size.select("book_id", "page_seq", "page_id", before.alias("start"), (before + F.col("size")).alias("end"))


def lines(pages: DataFrame) -> DataFrame:
    """book_id, page_seq, page_id, line_no, local (offset within the page), line; narrow."""
    exploded = pages.select("book_id", "page_seq", "page_id", F.posexplode(lines_of("content")).alias("line_no", "x"))
    return exploded.select("book_id", "page_seq", "page_id", "line_no", F.col("x.local").alias("local"), F.col("x.line").alias("line"))


#: Elements that are summed in one fold.
BLOCK = 128


def running_sums(sizes: Column) -> Column:
    """For each element of an array of numbers the sum of those before it.

    A fold copies its growing array at each step, so one over all elements would be quadratic; in blocks of
    ``BLOCK`` it costs so much an element, and the fold over the blocks a step for each block.
    """
    ends = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    within = F.transform(blocks, ends)
    bases = F.slice(ends(F.transform(within, lambda w: F.element_at(w, -1))), F.lit(1), F.size(blocks))
    long = F.flatten(F.zip_with(within, bases, lambda w, base: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: x + base)))
    return F.when(F.size(sizes) <= BLOCK, F.slice(ends(sizes), F.lit(1), F.size(sizes))).otherwise(long)


def lines_of(content: str) -> Column:
    """The lines of a text with their offsets in it, as an array of (line, local)."""

    def listed(parts: Column) -> Column:
        local = bound(F.transform(parts, lambda p: F.length(p) + 1), running_sums)
        return F.zip_with(parts, local, lambda line, at: F.struct(line.alias("line"), at.alias("local")))

    return bound(F.split(content, "\n", -1), listed)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named: within lambdas Spark computes each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def locate(points: DataFrame, pages: DataFrame, at: str = "idx") -> DataFrame:
    """``points`` (book_id, ``at``) with the page that each book offset lies on; past the end, the last page.

    As-of join without a range join: pages' starts and points are merged in one window per book.
    """
    marks = page_offsets(pages).select("book_id", F.col("start").alias("qw_at"), F.lit(0).alias("qw_kind"), F.struct("page_seq", "page_id", "start").alias("qw_page"), F.lit(None).cast(points.schema).alias("qw_row"))
    asked = points.select("book_id", F.col(at).cast("long").alias("qw_at"), F.lit(1).alias("qw_kind"), F.lit(None).cast(marks.schema["qw_page"].dataType).alias("qw_page"), F.struct(*points.columns).alias("qw_row"))
    seen = F.last("qw_page", ignorenulls=True).over(W.partitionBy("book_id").orderBy("qw_at", "qw_kind"))
    return marks.unionByName(asked).withColumn("qw_page", seen).where("qw_kind = 1").select("qw_row.*", "qw_page.page_seq", "qw_page.page_id", (F.col("qw_at") - F.col("qw_page.start")).alias("local"))
