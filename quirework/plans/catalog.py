"""Registry of the library's own queries and the SQL they are checked against.

Most read whole ``documents`` as books, each document a book of pages of three lines, so that books are
as many as documents and none is large; ``conversations`` are books of turns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import templates, text
from ..operators import check, detect, layout, lexicon, mine
from ..operators.segment import segment_pages
from ..sources import pages as books
from ..streaming import pages as streams
from . import advisor, oracles, profiles, tooling

Query = Callable[[SparkSession, str], DataFrame]
STARTS = ("The ", "And ", "Of ", "De ", "En ", "La ")
ANY_START = "|".join(STARTS)
PROFILE = profiles.PROFILES["plain"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return books.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def document_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a book; narrow."""
    return _paged(_table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("book_id"), F.split("text", "\n", -1).alias("lines")))


def chat_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a book of turns."""
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), seq.alias("page_seq"), F.col("turn").cast("long").alias("page_id"), F.coalesce("text", F.lit("")).alias("content"))


def _paged(listed: DataFrame) -> DataFrame:
    """Pages of three lines each, from book_id and lines; narrow."""
    n = oracles.LINES_PER_PAGE
    paged = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / n).cast("int")), lambda k: F.array_join(F.slice("lines", k * n + 1, F.lit(n)), "\n"))
    out = listed.select("book_id", F.posexplode(paged).alias("k", "content"))
    number = (F.col("k") + 1).cast("long")
    return out.select("book_id", number.alias("page_seq"), number.alias("page_id"), "content")


def _bare(text: Column) -> Column:
    """A text's lines with their words in Arabic letters.

    All that is no letter, blank or line break goes in the same translation: a class of characters costs the
    regex engine several times as much.
    """
    others = F.translate(text, f"{oracles.LATIN} \n", "")
    letters = F.call_function("translate", text, F.concat(F.lit(oracles.LATIN), others), F.lit(oracles.ARABIC))
    return F.transform(F.split(F.regexp_replace(letters, " {2,}", " "), "\n", -1), lambda line: F.trim(line))


def lexicon_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a lexicon: its lines in Arabic letters, as headings, entries, prose, remarks and paired forms in turn.

    The letters leave out some that every word of the engine's own lists has, so only what is put here is found.
    """

    def built(a: Column, i: Column) -> Column:
        w = F.substring_index(a, " ", 1)
        r = F.substring(a, F.length(w) + 2, F.length(a))
        shapes = [F.concat(F.lit("## باب "), w), F.concat(w, F.lit(": "), r), F.concat(F.lit("## "), w), a, F.concat(F.lit("قال: "), r), F.concat(w, F.lit("، "), F.substring_index(r, " ", 1), F.lit(": "), r)]
        out = F.when((F.length(w) < 2) | (r == ""), "")
        for k, shape in enumerate(shapes):
            out = out.when(i % 6 == k, shape)
        return out

    listed = _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("book_id"), _bare(F.col("text")).alias("bare"))
    return _paged(listed.select("book_id", F.transform("bare", built).alias("lines")))


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a book of one page."""
    one = F.lit(1).cast("long")
    return _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("book_id"), one.alias("page_seq"), F.col("doc_id").cast("long").alias("page_id"), F.col("text").alias("content"))


def _flat(segments: DataFrame) -> DataFrame:
    return segments.select("book_id", F.col("seg_seq").cast("long").alias("seg_seq"), "content", "from_id", "to_id", F.coalesce(F.to_json("meta"), F.lit("{}")).alias("meta"))


def _cut(options: dict, source: Query = document_books) -> Query:
    return lambda spark, sf_dir: _flat(segment_pages(source(spark, sf_dir), options))


def _with(pairs: tuple) -> Column:
    """The documents' text with what the tables lack put in."""
    out = F.col("text")
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _cleaned(column: Callable, dirt: tuple = ()) -> Query:
    return lambda spark, sf_dir: _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", _with(dirt).alias("text")).select("doc_id", column(F.col("text")).alias("content"))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_offsets(chat_books(spark, sf_dir)).select("book_id", "page_seq", "page_id", "start", (F.col("end") - F.col("start")).alias("size"))


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(document_books(spark, sf_dir)).select("book_id", "page_seq", F.col("line_no").cast("long").alias("line_no"), F.col("local").cast("long").alias("local"), "line")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, options = document_books(spark, sf_dir), {"rules": [{"lineStartsWith": list(STARTS)}]}
    found = check.measured(pages, options)
    return found.select(F.col("segment_count").alias("segments"), "issues", "errors", "warnings", (F.col("issues") == 0).alias("ok"))


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of segments that were damaged in seven ways, told apart by their number and book."""
    pages, options = chat_books(spark, sf_dir), {"maxPages": 0, "breakpoints": [""]}
    order = W.partitionBy("book_id").orderBy("seg_seq")
    good = segment_pages(pages, options).withColumns({"kind": F.pmod(F.col("book_id").cast("long") + F.col("seg_seq"), F.lit(8)), "next": F.lead("content").over(order), "after": F.lead("from_id").over(order)})
    kind = lambda k: F.col("kind") == k
    bad = good.withColumns({
        "content": F.when(kind(1), F.concat(F.lit("absent "), "content")).when(kind(3), F.concat("content", F.lit(" and a tail that no page has"))).when(kind(4) & F.col("next").isNotNull(), F.concat_ws(" ", "content", "next")).when(kind(7), F.lit("")).otherwise(F.col("content")),
        "from_id": F.when(kind(2), F.lit(-5)).when(kind(6) & F.col("after").isNotNull(), F.col("after")).otherwise(F.col("from_id")),
        "to_id": F.when(kind(5), F.coalesce("after", F.lit(-7))).otherwise(F.col("to_id")),
    })
    return check.validate_segments(pages, options, bad).select("book_id", F.col("seg_seq").cast("long").alias("seg_seq"), "type", "from_id", "to_id", "found_id", "actual_to")


CANDIDATES = [{"rules": [{"lineStartsWith": list(STARTS)}]}, {"maxPages": 0, "breakpoints": [""]}, {"rules": [{"regex": "("}]}]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.score_candidates(chat_books(spark, sf_dir), CANDIDATES).select("index", "score", "segment_count", "max_length", "multi_page", "issues", "best")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = books.row_chunks(_table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")
    return books.chunk_manifest(chunked, "doc_id").select(F.col("chunk").cast("long").alias("chunk"), "rows", "first", "last")


def _book_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.validate_book(chat_books(spark, sf_dir)).groupBy("problem").agg(F.count(F.lit(1)).alias("count"))


def _line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.common_line_starts(document_books(spark, sf_dir), sort_by="count").select("pattern", "count", F.get("examples", 0)["line"].alias("example"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine.repeating_sequences(whole_documents(spark, sf_dir), 2, 2, require_token=False, max_unique_patterns=None, max_examples=0)
    return found.select("pattern", "count", F.col("token_count").cast("long").alias("token_count"), F.col("literal_length").cast("long").alias("literal_length"))


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.lines(document_books(spark, sf_dir)).select("book_id", "page_seq", "line_no", "line")
    return detect.suggest_rules(lines).groupBy("pattern_type", "meta_type").agg(F.count(F.lit(1)).alias("lines"))


def _templates(spark: SparkSession, _: str) -> DataFrame:
    rows = [(t, templates.expand_tokens(t), ",".join(templates.expand(t).captures)) for t in ("{{raqms:num}} {{dash}}", "{{naql}} {{:rest}}", "{{num:a}}/{{num:a}}", "{{none}}")]
    return _rows(spark, rows, "template string, pattern string, captures string")


def _optimized(spark: SparkSession, _: str) -> DataFrame:
    rules, merged = tooling.optimize_rules([{"lineStartsWith": ["A"]}, {"template": "{{raqms}} {{dash}} long"}, {"lineStartsWith": ["Longer", "A"]}, {"lineEndsWith": ["."]}])
    return _rows(spark, [(k, json.dumps(r, sort_keys=True), merged) for k, r in enumerate(rules)], "place int, rule string, merged int")


def _rule_issues(spark: SparkSession, _: str) -> DataFrame:
    rules = [{"lineStartsWith": ["{{raqms}} x", "raqms x", "{{nope}}", "", "{{raqms}} x"]}, {"regex": "("}, {"dictionaryEntry": {"stopWords": "no", "minLetters": 0}}]
    return _rows(spark, [(k, r) for k, r in enumerate(tooling.format_report(tooling.validate_rules(rules)))], "place int, issue string")


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the headings made from lines, in five shapes, are of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.classify_heading(h) for h in batch.column(0).to_pylist()], pa.string())], ["kind"])

    lines = _table(spark, sf_dir, "documents").where("text is not null").select(F.posexplode(_bare(F.col("text"))).alias("n", "a"))
    w = F.substring_index("a", " ", 1)
    some = lines.where((F.length(w) >= 2) & (F.length("a") > F.length(w) + 1)).select("n", w.alias("w"))
    shapes = F.array(F.concat(F.lit("## باب "), "w"), F.concat(F.lit("## "), "w"), F.concat(F.lit("## ["), F.array_join(F.split("w", ""), " "), F.lit("]")), F.concat(F.lit("## قال "), F.array_join(F.array_repeat("w", 4), " ")), F.concat(F.lit("## "), "w", F.lit("، "), "w", F.lit(" غيرها: مهملة")))
    return some.select(F.get(shapes, F.col("n") % 5).alias("heading")).mapInArrow(run, "kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("headings"))


def _diagnosed(facet: str) -> Query:
    return lambda spark, sf_dir: lexicon.diagnose(lexicon_books(spark, sf_dir), PROFILE)[facet]


def _advised(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = advisor.suggest_options(document_books(spark, sf_dir))
    rows = [(k, s["source"], s["confidence"], s["pattern"], s["count"], report["assessment"]["mode"]) for k, s in enumerate(report["rule_suggestions"])]
    return _rows(spark, rows, "place int, source string, confidence string, pattern string, count long, mode string")


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.page_detections(whole_documents(spark, sf_dir).withColumnRenamed("content", "text").withColumn("content", _with(oracles.DIRT)))


GUARDED = {"lineStartsWith": ["The ", "Of "], "pageStartGuard": "{{tarqim}}"}
CAPTURED = {"regex": "^(?<w>The|And|Of|De|La) ", "meta": {"kind": "head"}}
_REGISTERED: dict[str, tuple[Query, str | None]] = {
    # segmentation
    "segment_documents": (_cut({"rules": [{"lineStartsWith": list(STARTS)}]}), oracles.split(oracles.line_hits(f"^(?:{ANY_START})"))),
    "split_starts_after": (_cut({"rules": [{"lineStartsAfter": list(STARTS)}]}), oracles.split(oracles.line_hits(f"^(?:{ANY_START})", off=f"length(regexp_extract(line, '^(?:{ANY_START})'))"))),
    "split_ends_with": (_cut({"rules": [{"lineEndsWith": ["re\\.", "on\\."]}]}), oracles.split(oracles.line_hits(r"(?:re\.|on\.)$", at="local + length(line) - 3"))),
    "split_ends_with_after": (_cut({"rules": [{"lineEndsWith": ["re\\.", "on\\."], "split": "after"}]}), oracles.split(oracles.line_hits(r"(?:re\.|on\.)$", at="local + length(line)"))),
    "split_template": (_cut({"rules": [{"template": "{{tarqim}}{{newline}}", "split": "after"}]}), oracles.split(oracles.sentence_line_hits())),
    "split_regex_capture": (_cut({"rules": [CAPTURED]}), oracles.split(oracles.line_hits("^(?:The|And|Of|De|La) ", meta="""'{"kind":"head","w":"' || regexp_extract(line, '^(The|And|Of|De|La) ', 1) || '"}'"""))),
    "split_first": (_cut({"rules": [{"lineStartsWith": list(STARTS), "occurrence": "first"}]}), oracles.split(oracles.nth_hit(oracles.line_hits(f"^(?:{ANY_START})"), "ASC"))),
    "split_last": (_cut({"rules": [{"lineStartsWith": list(STARTS), "occurrence": "last"}]}), oracles.split(oracles.nth_hit(oracles.line_hits(f"^(?:{ANY_START})"), "DESC"))),
    "split_page_range": (_cut({"rules": [{"lineStartsWith": list(STARTS), "min": 2, "max": 9, "exclude": [3, [5, 6]]}]}), oracles.split(oracles.line_hits(f"^(?:{ANY_START})", where="page_id BETWEEN 2 AND 9 AND page_id NOT IN (3, 5, 6)"), preamble="first_id >= 2")),
    "split_page_guard": (_cut({"rules": [GUARDED]}), oracles.split(oracles.guarded_hits("^(?:The |Of )"))),
    "split_newline_joiner": (_cut({"rules": [{"lineStartsWith": list(STARTS)}], "pageJoiner": "newline"}), oracles.split(oracles.line_hits(f"^(?:{ANY_START})"), joiner="chr(10)")),
    "split_two_rules": (_cut({"rules": [{"lineStartsWith": ["The "], "meta": {"kind": "a"}}, {"lineStartsWith": ["Of "], "meta": {"kind": "b"}}]}), oracles.split(oracles.line_hits("^(?:The |Of )", meta="""CASE WHEN line LIKE 'The %' THEN '{"kind":"a"}' ELSE '{"kind":"b"}' END"""))),
    "split_fuzzy_entries": (_cut({"rules": [{"lineStartsAfter": ["## {{bab}} "], "meta": {"type": "chapter"}}, {"dictionaryEntry": {"stopWords": ["قال"]}}]}, lexicon_books), oracles.fuzzy_entries()),
    # breakpoints
    "break_single_pages": (_cut({"maxPages": 0, "breakpoints": [""]}, chat_books), oracles.page_breaks(0)),
    "break_one_page_on": (_cut({"maxPages": 1, "breakpoints": [""]}, chat_books), oracles.page_breaks(1)),
    "break_punctuation": (_cut({"maxPages": 1, "breakpoints": ["{{tarqim}}\\s*", ""]}), None),
    "break_shorter": (_cut({"maxPages": 0, "breakpoints": ["{{tarqim}}"], "prefer": "shorter"}), oracles.shorter_breaks()),
    "break_words": (_cut({"maxPages": 1, "breakpoints": [{"words": ["the ", "de ", "und "]}]}), None),
    "break_length": (_cut({"maxContentLength": 500, "breakpoints": ["{{tarqim}}", "{{newline}}", ""]}), None),
    # projections and sources
    "clean_zero_width": (_cleaned(text.remove_zero_width, oracles.DIRT), oracles.preprocessed(r"regexp_replace(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')", oracles.DIRT)),
    "clean_ellipsis": (_cleaned(text.condense_ellipsis, oracles.DIRT), oracles.preprocessed("regexp_replace(text, '[.]{2,}', '…', 'g')", oracles.DIRT)),
    "clean_waw": (_cleaned(text.fix_trailing_waw, oracles.DIRT), oracles.preprocessed("replace(text, ' و ', ' و')", oracles.DIRT)),
    "collapse_whitespace": (_cleaned(text.collapse_whitespace), oracles.preprocessed(oracles._trim(f"regexp_replace(text, '{oracles.SPACE}+', ' ', 'g')"))),
    "normalize_for_comparison": (_cleaned(text.normalize_for_comparison, oracles.MARKED), oracles.preprocessed("translate(regexp_replace(" + oracles._trim(f"regexp_replace(regexp_replace(nfc_normalize(text), '[\\x{{200C}}\\x{{200D}}]', '', 'g'), '{oracles.SPACE}+', ' ', 'g')") + r", '[\x{0610}-\x{061A}\x{0640}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]', '', 'g'), 'آأإةى', 'اااهي')", oracles.MARKED)),
    "html_text": (lambda spark, sf_dir: _table(spark, sf_dir, "pages").where("html is not null").select("page_id", text.strip_html("html").alias("content")), oracles.html_text()),
    "page_offsets": (_offsets, f"WITH {oracles.CHATS} SELECT book_id, page_seq, page_id, CAST(start AS BIGINT) AS start, size FROM starts"),
    "page_lines": (_line_rows, f"WITH {oracles.PAGES} SELECT book_id, page_seq, line_no, CAST(local AS BIGINT) AS local, line FROM lines"),
    "row_chunks": (_chunks, "SELECT chunk, count(*) AS rows, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil((SELECT count(*) FROM documents) / 7) AS BIGINT) AS chunk FROM documents) GROUP BY chunk"),
    "book_problems": (_book_problems, f"WITH {oracles.CHATS}, p AS (SELECT CASE WHEN page_id IS NULL OR page_id <= 0 THEN 'id_not_positive' WHEN count(*) OVER (PARTITION BY book_id, page_id) > 1 THEN 'duplicate_id' WHEN content = '' THEN 'empty_content' END AS problem FROM pages) SELECT problem, count(*) AS count FROM p WHERE problem IS NOT NULL GROUP BY problem"),
    # detection and mining
    "detect_tokens": (lambda spark, sf_dir: detect.token_counts(whole_documents(spark, sf_dir)), oracles.token_counts()),
    "suggest_rules": (_suggested, oracles.suggested()),
    "preprocess_detections": (_detections, oracles.detections()),
    "common_line_starts": (_line_starts, oracles.line_starts(40, 3)),
    "repeating_sequences": (_sequences, oracles.sequences(20, 3)),
    # validation and advice
    "validate_segments": (_validated, oracles.no_issues(oracles.split(oracles.line_hits(f"^(?:{ANY_START})")))),
    "validate_damaged": (_damaged, oracles.damaged()),
    "score_candidates": (_scored, oracles.scored(f"^(?:{ANY_START})")),
    "advise_options": (_advised, oracles.advised(12, 8, 3)),
    # lexicon
    "lexicon_segments": (_cut({"dictionary": PROFILE}, lexicon_books), oracles.lexicon_segments()),
    "lexicon_surface": (lambda spark, sf_dir: lexicon.surface_counts(lexicon_books(spark, sf_dir)), oracles.lexicon_surface()),
    "lexicon_totals": (_diagnosed("totals"), oracles.lexicon_counts("count(*) FILTER (kind IN (0, 1, 2)) AS accepted, count(*) FILTER (kind = 4) AS rejected")),
    "lexicon_by_kind": (_diagnosed("by_kind"), oracles.lexicon_counts("CASE kind WHEN 0 THEN 'chapter' ELSE 'entry' END AS kind, count(*) FILTER (kind <> 4) AS accepted, count(*) FILTER (kind = 4) AS rejected", "WHERE kind IN (0, 1, 2, 4) GROUP BY 1")),
    "lexicon_by_reason": (_diagnosed("by_reason"), oracles.lexicon_counts("'stopLemma' AS reason, count(*) AS count", "WHERE kind = 4 HAVING count(*) > 0")),
    "heading_classes": (_headings, oracles.heading_kinds()),
    # configuration
    "expand_templates": (_templates, None),
    "optimize_rules": (_optimized, None),
    "validate_rules": (_rule_issues, None),
    # streaming
    "stream_line_starts": (lambda spark, sf_dir: streams.count_line_starts(spark, f"{sf_dir}/documents.parquet"), oracles.first_words()),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
