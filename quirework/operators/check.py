"""Validation of segments against their pages, previews and scores of candidate options."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.config import Options
from .layout import batched, books, by_book, prepared
from .segment import segment_pages

SHORT = 500
#: Characters around a segment's own pages in which a text of any length is looked for.
NEAR = 1000
ISSUE = "book_id string, seg_seq int, type string, severity string, from_id long, to_id long, found_id long, expected_from long, expected_to long, actual_from long, actual_to long, preview string, evidence string, hint string"
HINTS = {
    "page_not_found": "check the page ids of the pages and of the segments",
    "max_pages_violation": "check maxPages and the breakpoints",
    "page_attribution_mismatch": "check how repeated texts and page boundaries were attributed",
    "content_not_found": "check preprocessing, the page joiner and white space",
}


class _Searched:
    """A book's joined text; finds where a segment's content really is."""

    def __init__(self, pages: list[tuple[int | None, str]], glue: str, max_pages: int | None, full_below: int):
        self.ids, self.text, self.starts, start = [i for i, _ in pages], glue.join([t for _, t in pages]), [], 0
        #: The last place of each page id.
        self.at = {i: k for k, i in enumerate(self.ids) if i is not None}
        self.max_pages, self.full_below = max_pages, full_below
        for _, t in pages:
            self.starts.append(start)
            start += len(t) + 1

    def page(self, at: int) -> int:
        return self.ids[bisect_right(self.starts, at) - 1]

    def end(self, k: int) -> int:
        return self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text) + 1

    def issues(self, content: str, from_id: int | None, to_id: int | None) -> Iterator[tuple]:
        """(type, found_id, expected_from, expected_to, actual_to, evidence) of each: first what ids alone tell, then what the text does."""
        last_id, shown, most = from_id if to_id is None else to_id, lambda i: "null" if i is None else i, self.max_pages
        first, last = self.at.get(from_id), self.at.get(last_id)
        if first is None:
            yield "page_not_found", None, None, None, to_id, f"no page has the id {shown(from_id)} that the segment begins on"
        elif last is None:
            yield "page_not_found", None, None, None, to_id, f"no page has the id {shown(last_id)} that the segment ends on"
        if first is None:
            return
        if most is not None and to_id is not None and ((span := to_id - from_id) > most or most == 0 and span != 0):
            yield "max_pages_violation", None, from_id, from_id + most, to_id, f"the segment spans {span} pages, maxPages is {most}"
        start = self.starts[first]
        if content and last is not None and self.text.find(content, start, self.end(last) - 1) >= 0:
            return  # it lies on its own pages
        found = self.judge(content, start, self.end(last) if last is not None else len(self.text) + 1, from_id, to_id)
        if found:
            kind, page, low, high, ends = found
            told = {"max_pages_violation": f"the content ends on page {ends}, not by {high}", "page_attribution_mismatch": f"the content is on page {page}, not {from_id}", "content_not_found": f"its {len(content)} characters are not where they should be"}[kind]
            yield kind, page, low, high, ends, told

    def judge(self, content: str, start: int, end: int, from_id: int, to_id: int | None) -> tuple | None:
        """(type, found_id, expected_from, expected_to, actual_to), or None if all is well.

        The first match that begins on the segment's own pages counts; it may run on to later ones.
        """
        max_pages, size = self.max_pages, len(content)
        if not content:
            return "content_not_found", None, None, None, to_id
        hit = self.text.find(content, start, end - 1 + size)
        if 0 <= hit < end:
            ends = self.page(hit + size - 1)
            if to_id is not None and max_pages is not None and to_id - from_id > max_pages:
                return None  # told already
            if max_pages == 0 and ends != from_id:
                return "max_pages_violation", None, from_id, from_id, ends
            most = to_id if to_id is not None else None if max_pages is None else from_id + max_pages
            return None if most is None or ends <= most else ("max_pages_violation", None, from_id, most, ends)
        near = self.text.find(content, max(0, start - NEAR), end + NEAR - 1 + size)
        hit = near if 0 <= near < end + NEAR else self.text.find(content) if size < self.full_below else -1
        if hit < 0:
            return "content_not_found", None, None, None, to_id
        return "page_attribution_mismatch", self.page(hit), self.page(hit), self.page(hit + size - 1), to_id


def validate_segments(pages: DataFrame, options: dict | Options, segments: DataFrame, full_search_below: int = SHORT) -> DataFrame:
    """A row for each issue of a segment: type, severity, found_id, what was expected and is, preview, evidence, hint.

    ``page_not_found``: no page of the from or to id.  ``max_pages_violation``: the ids span more than maxPages,
    or the content, begun on its own pages, ends on a later one than ``to`` or maxPages allow.
    ``page_attribution_mismatch``: the content as a whole begins on other pages of the joined text, within
    ``NEAR`` characters of its own or, if it is short, anywhere.  ``content_not_found``: it doesn't.
    """
    return _judged(pages, options, segments, full_search_below).where("type is not null").drop("counted").withColumn("preview", X.preview("preview"))


#: What a worker counts of the segments that it sees; a row of its own among the issues.
COUNTED = [("segments", pa.int64()), ("characters", pa.int64()), ("longest", pa.int32()), ("multi_page", pa.int64())]


def _judged(pages: DataFrame, options: dict | Options, segments: DataFrame, full_below: int = SHORT) -> DataFrame:
    """Rows of issues with the whole content as ``preview``, and rows that have only ``counted``.

    A book's pages and, after them, its segments come to a worker together: each text is shuffled once, however
    many pages a segment spans, and a book is held while its segments are looked at, without a cap on hits.
    """
    o = Options.of(options)
    glue, max_pages = o.glue, o.max_pages
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.string(), pa.struct(COUNTED)]
    schema = f"{ISSUE}, counted struct<segments:long,characters:long,longest:int,multi_page:long>"
    arrow = pa.schema(list(zip([f.split()[0] for f in ISSUE.split(", ")] + ["counted"], kinds, strict=True)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        count = total = longest = multi = 0
        for _, book in books(batches):
            held: list[tuple[int | None, str]] = []
            text = None
            for name, is_segment, seq, from_id, to_id, content in book:
                if not is_segment:
                    held.append((from_id, content))
                    continue
                text = text or _Searched(held, glue, max_pages, full_below)
                count, total, longest, multi = count + 1, total + len(content), max(longest, len(content)), multi + (to_id is not None and to_id != from_id)
                for kind, page, low, high, ends, told in text.issues(content, from_id, to_id):
                    yield name, seq, kind, "error", from_id, to_id, page, low, high, from_id, ends, content, told, HINTS[kind], None
        if count:
            yield (*[None] * 14, dict(zip((c for c, _ in COUNTED), (count, total, longest, multi), strict=True)))

    texts = prepared(pages, o.preprocess).select("book_id", F.lit(False).alias("is_segment"), "page_seq", F.col("page_id").alias("from_id"), F.lit(None).cast("long").alias("to_id"), "content")
    asked = segments.select("book_id", F.lit(True).alias("is_segment"), F.col("seg_seq").cast("long").alias("page_seq"), "from_id", "to_id", F.coalesce("content", F.lit("")).alias("content"))
    return by_book(texts.unionByName(asked), "is_segment", "page_seq").mapInArrow(lambda batches: batched(rows(batches), arrow, 11), schema)


def measured(pages: DataFrame, options: dict | Options, segments: DataFrame | None = None) -> DataFrame:
    """One row: what ``segment_stats`` and ``validation_summary`` tell of the options' segments, which are made and looked at once."""
    o = Options.of(options)
    found = _judged(pages, o, segment_pages(pages, o) if segments is None else segments)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = total("counted.segments")
    return found.agg(
        n.alias("segment_count"), F.when(n == 0, 0.0).otherwise(total("counted.characters") / F.greatest(n, F.lit(1))).alias("average_length"), F.coalesce(F.max("counted.longest"), F.lit(0)).alias("max_length"), total("counted.multi_page").alias("multi_page"),
        F.count("type").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def validation_summary(issues: DataFrame, segments: DataFrame) -> DataFrame:
    """segments, issues, errors, warnings, and ok."""
    totals = issues.agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return totals.crossJoin(segments.agg(F.count(F.lit(1)).alias("segments"))).select("segments", "issues", "errors", "warnings", (F.col("issues") == 0).alias("ok"))


def segment_stats(segments: DataFrame) -> DataFrame:
    """segment_count, average_length, max_length, multi_page."""
    return segments.agg(
        F.count(F.lit(1)).alias("segment_count"), F.coalesce(F.avg(F.length("content")), F.lit(0.0)).alias("average_length"), F.coalesce(F.max(F.length("content")), F.lit(0)).alias("max_length"),
        F.count_if(F.col("to_id").isNotNull() & (F.col("to_id") != F.col("from_id"))).alias("multi_page"),
    )


def preview_segmentation(pages: DataFrame, options: dict | Options, sample: int = 10) -> dict:
    """Segments, their statistics, the first few of them and their issues."""
    segments = segment_pages(pages, options)
    issues = validate_segments(pages, options, segments)
    return {"segments": segments, "stats": segment_stats(segments), "samples": segments.orderBy("book_id", "seg_seq").limit(sample), "issues": issues}


def first_segments(pages: DataFrame, options: dict | Options, most: int) -> list[Row]:
    """The first segments of all, from so few books at first; only if these have too few all books are cut."""
    rows: list[Row] = []
    some = [r["book_id"] for r in pages.select("book_id").distinct().orderBy("book_id").limit(most).collect()]  # ``most`` names
    for part in [pages.where(F.coalesce(F.col("book_id") <= some[-1], F.lit(True))), pages] if some else []:
        rows = segment_pages(part, options).orderBy("book_id", "seg_seq").limit(most).collect()
        if len(rows) == most or len(some) < most:
            break
    return rows


def score(segment_count: int, issues: int, multi_page: int, max_length: int) -> int:
    return min(segment_count, 200) - 100 * issues - 5 * multi_page - max_length // 500


def score_candidates(pages: DataFrame, candidates: list[dict]) -> DataFrame:
    """index, score, segment_count, average_length, max_length, multi_page, issues, error, best for each.

    A candidate whose options are wrong scores minus infinity, with the error; of equals the first is best.
    """
    rows = []
    for index, options in enumerate(candidates):
        try:
            m = measured(pages, options).first()
            rows.append((index, float(score(m["segment_count"], m["issues"], m["multi_page"], m["max_length"])), m["segment_count"], m["average_length"], m["max_length"], m["multi_page"], m["issues"], None))
        except ValueError as e:
            rows.append((index, -math.inf, None, None, None, None, None, str(e)))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0] if rows else -1
    schema = "index int, score double, segment_count long, average_length double, max_length int, multi_page long, issues long, error string, best boolean"
    return pages.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], schema)
