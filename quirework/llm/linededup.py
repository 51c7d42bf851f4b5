"""Line dedup: a suffix array over line-ID sequences, built by distributed prefix doubling.

Every document is a sequence of line IDs (128-bit line hashes, which also give their order).  The rank of
a suffix by ``h`` lines is its place in the suffix array so far: a number that is the larger the later it
sorts, equal ones sharing it.  The rank by ``2h`` lines comes from the pair (rank here, rank ``h`` lines
further on), the distinct pairs being sorted by ranges and numbered, and a depth between two powers of
two from two ranks that overlap.  Suffixes of equal rank by ``h`` lines are an interval of the suffix
array whose longest common prefix is ``h`` or more.  A suffix alone in its interval is discarded at once,
so after the first round only repeated text is left; doubling goes on until all ranks are unique or all
runs have ended.

In each interval the member first in (doc_id, line) order stays; the ``h`` lines at all others are copies.
A maximal repeated run of ``n`` lines, ``2**k`` the largest power of two in ``n``, is the union of its windows of
``2**k`` lines at its start and at its end, so the intervals by powers of two cover it whole.

A window counts from ``min_lines`` lines or, in fewer lines, from ``min_words`` words; windows of 1 to
``min_lines`` lines and of all larger powers of two are tested at each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import checkpoint, fresh

NO_ID = -(1 << 63)
SUFFIX = ["did", "key", "pos"]


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("doc_id", "text").alias("key")]


def _words(line: Column) -> Column:
    return F.when(F.trim(line) == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _lines(docs: DataFrame) -> DataFrame:
    """did, key, pos, before (0), after (words of the line), depth (1), by1, by2 (the line's ID)."""
    per_doc = docs.where(F.col("text").isNotNull()).select(*_keys(), F.split("text", "\n", -1).alias("lines"))
    lines = per_doc.select("did", "key", F.posexplode("lines").alias("pos", "line"))
    return lines.select(*SUFFIX, F.lit(0).alias("before"), _words(F.col("line")).alias("after"), F.lit(1).alias("depth"), F.xxhash64("line").alias("by1"), F.xxhash64(F.lit(1), "line").alias("by2"))


def _ranked(suffixes: DataFrame) -> DataFrame:
    """``suffixes`` by (depth, by1, by2): those that aren't alone, with ``rank`` and whether an earlier one is equal (``later``).

    Groups come from an aggregate with map-side combining and are joined back, so a line that a billion
    documents have is one row there, and AQE may split its side of the join.  Sorted by ranges they are
    numbered in order; the numbers are written before they are used, so a lost executor can't change them.
    """
    by = ["depth", "by1", "by2"]
    groups = suffixes.groupBy(*by).agg(F.min(F.struct(*SUFFIX)).alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    ranks = checkpoint(groups.select(*by, "head").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))
    later = (F.struct(*SUFFIX) != F.col("head")).alias("later")
    return checkpoint(suffixes.join(ranks, by).select(*SUFFIX, "before", "after", "depth", "rank", later))


def _counted(lines: DataFrame) -> DataFrame:
    """Repeated lines, each once, with the words of those before and up to it in their document.

    All lines of a repeated window are repeated, so its words are the difference of two such sums.
    """
    once = lines.repartition("did", "key").dropDuplicates(SUFFIX)
    before = F.coalesce(F.sum("after").over(W.partitionBy("did", "key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return once.withColumn("before", before.cast("int")).withColumn("after", F.col("before") + F.col("after"))


def repeated_windows(docs: DataFrame, min_lines: int = 3, min_words: int = 50, least_words: int = 5) -> DataFrame:
    """did, key, pos, depth: windows of ``depth`` lines from ``pos`` that count and of which there is an earlier copy."""
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    words = F.col("after") - F.col("before")
    counts = (words >= min_words) | (F.col("depth") >= min_lines) & (words >= min(min_words, least_words))
    size, found = 1, _ranked(checkpoint(_lines(docs)))
    hits = []
    while True:
        hits.append(found.where(F.col("later") & counts).select(*SUFFIX, "depth"))
        state = found.where(F.col("depth") == size)
        if state.isEmpty():
            break
        if size == 1:
            state = _counted(state)
        order = W.partitionBy("did", "key").orderBy("pos")
        depths = [*range(size + 1, min(2 * size - 1, min_lines) + 1), 2 * size]
        ahead = [F.first(F.struct(F.lit(d).alias("depth"), F.col("rank").alias("by2"), F.col("after").alias("end"))).over(order.rangeBetween(d - size, d - size)) for d in depths]
        pairs = state.select(*SUFFIX, "before", F.col("rank").alias("by1"), F.array(*ahead).alias("xs")).select(*SUFFIX, "before", "by1", F.explode(F.array_compact("xs")).alias("x"))
        size, found = 2 * size, _ranked(pairs.select(*SUFFIX, "before", F.col("x.end").alias("after"), "x.depth", "by1", "x.by2"))
    out = hits[0]
    for x in hits[1:]:
        out = out.unionByName(x)
    return out


def repeated_runs(docs: DataFrame, min_lines: int = 3, min_words: int = 50, least_words: int = 5) -> DataFrame:
    """did, key, start, end: stretches of lines that are copies; windows that touch or overlap are one stretch."""
    end = F.col("pos") + F.col("depth")
    doc = W.partitionBy("did", "key").orderBy("pos")
    windows = repeated_windows(docs, min_lines, min_words, least_words).groupBy(*SUFFIX).agg(F.max("depth").alias("depth"))
    reach = windows.withColumn("reach", F.max(end).over(doc.rowsBetween(W.unboundedPreceding, -1)))
    starts = F.sum(F.when(F.col("pos") <= F.col("reach"), 0).otherwise(1)).over(doc)
    return reach.withColumn("run", starts).groupBy("did", "key", "run").agg(F.min("pos").alias("start"), F.max(end).alias("end")).drop("run")


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50, least_words: int = 5) -> DataFrame:
    """``docs`` without the later copies of repeated line runs; a document that loses all its text goes.

    ``min_lines``/``min_words``: a run counts from so many lines or so many blank-separated words; with
    fewer than ``least_words`` words, so many lines don't count either (blank lines, single words).

    Only line hashes are shuffled to find the runs, and rows that repeat after that; the texts are
    shuffled once, to meet the lists of deleted lines.

    Defined cases: null and empty texts pass unchanged; a null doc_id sorts before all others; repeated
    rows (same doc_id and text) are one document, treated alike; runs repeated inside one document
    count, so a line repeated on and on shrinks to its first; copies tie on (doc_id, line), never on
    the input's order; other columns pass unchanged, but ``n_chars`` (if there) follows a changed text.
    """
    did, key, gone = fresh(docs, "qw_did", "qw_key", "qw_gone")
    runs = repeated_runs(docs, min_lines, min_words, least_words)
    lists = runs.groupBy("did", "key").agg(F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1))).alias(gone)).withColumnsRenamed({"did": did, "key": key})
    k1, k2 = _keys()
    keyed = docs.withColumns({did: k1, key: k2})
    joined = keyed.join(lists, [did, key], "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("text", text).where(F.col(gone).isNull() | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def oracle(min_lines: int = 3, min_words: int = 50, least_words: int = 5) -> str:
    """The same in DuckDB SQL, comparing the windows' lines themselves."""
    depths = sorted({*range(1, min_lines + 1), *(1 << k for k in range(20))})
    return f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, list_transform(lines, lambda x: CASE WHEN trim(x) = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END) AS words FROM d),
p AS (SELECT *, unnest(range(len(lines))) AS pos FROM w),
h AS (SELECT doc_id, pos, depth, md5(array_to_string(list_slice(lines, pos + 1, pos + depth), chr(10))) AS id, list_sum(list_slice(words, pos + 1, pos + depth)) AS words
      FROM p JOIN (SELECT unnest({depths}) AS depth) ON pos + depth <= len(lines)),
r AS (SELECT *, row_number() OVER (PARTITION BY depth, id ORDER BY doc_id, pos) AS nth FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + depth)) AS pos FROM r WHERE nth > 1 AND (words >= {min_words} OR depth >= {min_lines} AND words >= {min(min_words, least_words)})),
l AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
k AS (SELECT documents.*, gone, array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: NOT list_contains(gone, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)) AS left_text
      FROM documents LEFT JOIN l USING (doc_id))
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE left_text END AS text, lang, source, CASE WHEN gone IS NULL THEN n_chars ELSE length(left_text) END AS n_chars
FROM k WHERE gone IS NULL OR trim(translate(left_text, chr(10) || chr(9) || chr(13), '   ')) <> ''"""
