"""The cutter's single pass over a book against the same steps as columns, and what it holds and ships."""

import random
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.operators import check, layout
from quirework.operators.breaks import Breaker
from quirework.operators.segment import assembled, merged_points, rebroken, segment_pages, split_points
from quirework.operators.segment import cut as cut_at
from quirework.plans.config import Options
from quirework.sources.pages import PAGES

OPTIONS = [
    {"rules": [{"lineStartsWith": ["# ", "= "], "meta": {"k": "v"}}, {"lineStartsAfter": ["- "], "max": 6}]},
    {"rules": [{"lineEndsWith": ["!"], "split": "after"}, {"lineStartsWith": ["# "]}], "pageJoiner": "newline"},
    {"rules": [{"lineStartsWith": ["# "], "occurrence": "first"}, {"lineStartsAfter": ["- "], "occurrence": "last"}]},
    {"rules": [{"lineStartsWith": ["# "], "min": 4, "exclude": [5]}]},
    {"rules": [{"regex": "^(?<w>[#=]) "}, {"lineStartsWith": ["# "], "meta": {"a": "b"}}]},
    {"rules": [{"lineStartsWith": ["# ", "a"], "pageStartGuard": "{{tarqim}}"}, {"regex": "b\n(a)"}]},
    {"rules": [{"lineStartsWith": ["# "]}], "maxPages": 1, "breakpoints": ["{{tarqim}}", ""]},
    {"rules": [{"lineStartsWith": ["# "]}], "maxPages": 0, "breakpoints": [""]},
]


@pytest.fixture(scope="module")
def books(spark):
    """Random books of short pages; the last page isn't blank, as the columns' breaker fails on that."""
    pick = random.Random(7)
    rows = []
    for b in range(12):
        page_id = 0
        for seq in range(1, pick.randint(2, 9)):
            page_id += pick.choice([1, 1, 1, 3])
            rows.append((f"b{b}", seq, page_id, "".join(pick.choice(["# ", "= ", "- ", "a", "b", ". ", "!", "\n", "\n", " "]) for _ in range(pick.randint(0, 14)))))
        rows.append((f"b{b}", 99, page_id + 1, "# end"))
    return spark.createDataFrame(rows, PAGES).repartition(3)


@pytest.mark.parametrize("options", OPTIONS, ids=lambda o: str(o)[:60])
def test_one_pass_equals_the_columns(books, options):
    o = Options.of(options)
    by_columns = rebroken(assembled(cut_at(books, merged_points(split_points(books, o)), o), o), o).withColumn("seg_seq", F.row_number().over(W.partitionBy("book_id").orderBy("seg_no", "piece")))
    shape = lambda df: sorted((r["book_id"], r["seg_seq"], r["content"], r["from_id"], r["to_id"], sorted(r["meta"].items())) for r in df.select("book_id", "seg_seq", "content", "from_id", "to_id", "meta").collect())
    assert shape(segment_pages(books, options)) == shape(by_columns)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pages_are_shuffled_once_to_be_cut_and_once_with_their_segments_to_be_validated(books):
    for options in OPTIONS:
        assert exchanges(segment_pages(books, options)) == 1, options
    segments = segment_pages(books, OPTIONS[0])
    assert exchanges(check.validate_segments(books, OPTIONS[0], segments)) == 2
    assert exchanges(check.measured(books, OPTIONS[0])) == 2


def test_measured_equals_stats_and_summary(books):
    for options in (OPTIONS[0], OPTIONS[6]):
        segments = segment_pages(books, options)
        bad = segments.withColumn("content", F.when(F.col("seg_seq") == 2, F.concat("content", F.lit("?"))).otherwise(F.col("content")))
        want = check.segment_stats(bad).first().asDict() | check.validation_summary(check.validate_segments(books, options, bad), bad).drop("segments", "ok").first().asDict()
        assert check.measured(books, options, bad).first().asDict() == want and want["issues"] > 0


def test_first_segments_need_only_some_books(books):
    want = [tuple(r) for r in segment_pages(books, OPTIONS[0]).orderBy("book_id", "seg_seq").collect()]
    for most in (1, 5, 10_000):
        assert [tuple(r) for r in check.first_segments(books, OPTIONS[0], most)] == want[:most]


def test_batches_are_bounded():
    import pyarrow as pa

    schema = pa.schema([("a", pa.string())])
    sizes = [b.num_rows for b in layout.batched((("x" * 1000,) for _ in range(20_000)), schema, 0)]
    assert sum(sizes) == 20_000 and max(sizes) <= layout.BATCH_ROWS
    big = pa.RecordBatch.from_arrays([pa.array(["y" * 10_000] * 10_000)], ["a"])
    cut = list(layout.parts([big]))
    assert sum(p.num_rows for p in cut) == 10_000 and max(p.num_rows for p in cut) <= layout.PART_ROWS


def test_breaks_take_time_in_proportion_to_the_text():
    """A book of one long segment: no piece copies what follows it, and blank pages at its end do no harm."""

    def seconds(n):
        breaker, began = Breaker(Options.of({"maxPages": 1, "breakpoints": ["{{tarqim}}\\s*", ""]})), time.thread_time()
        assert len(breaker.pieces(list(range(n + 2)), ["Words of a page. " * 20] * n + [" ", ""])) >= n // 2
        return time.thread_time() - began

    seconds(100)
    assert seconds(32_000) < 12 * seconds(4_000) + 0.5
