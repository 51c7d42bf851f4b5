"""Segmentation: split points from rules, cut, and cut again where segments are too large.

Pages are shuffled once, by book, and come to a worker in order.  Rules that lines decide on their own are matched
in the JVM, line by line, before that, and then a book goes through the worker page by page; for all others, and
where the last match of a book counts, it is held as a whole.  The same steps as columns, from ``split_points`` to
``rebroken``, are what the tests compare with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dialect import for_java
from ..plans.config import Options, Rule
from .breaks import Breaker
from .cutter import Cutter, Mark, Segment, merged, once
from .layout import batched, books, bound, by_book, lines_of, prepared
from .scan import Book, Scanner

POINT = "book_id string, page_seq long, local int, ord int, offset int, captured string, meta map<string,string>, word int"
META = "map<string,string>"


#: What a pattern may hold so that no match can touch a line end: any other escape, class or flag might.
ONE_LINE = re.compile(r"""
    \\[dwbB] | \\[^A-Za-z0-9\s] | \\p\{(?:L|M|N|P|(?:Script|sc)=\w+)\}
    | \\u(?!2028|2029|0085)(?:00[2-9A-Fa-f]|0[1-9A-Fa-f]|[1-9A-Fa-f][0-9A-Fa-f])[0-9A-Fa-f]{1,2}
    | \((?!\?) | \(\?(?: : | = | ! | <= | <! | <\w+> )
    | \[(?!\^) | [^\\(\[\x00-\x1f\x85\u2028\u2029]
""", re.VERBOSE)  # fmt: skip


def line_native(rule: Rule) -> bool:
    """Can each line tell on its own whether the rule matches there?  What isn't known to stay in a line is scanned."""
    if not rule.line_anchored or rule.page_start_guard or rule.page_start_stoplist or rule.same_page_stoplist or "" in rule.patterns:
        return False
    source, at = rule.source(), 0
    while at < len(source):
        found = ONE_LINE.match(source, at)
        if not found:
            return False
        at = found.end()
    return True


def _map(pairs: list[tuple[Column, Column]]) -> Column:
    if not pairs:
        return F.create_map().cast(META)
    flat = F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    return F.map_filter(flat, lambda k, v: v.isNotNull())


def _ids(rule: Rule) -> Column:
    ok = F.lit(True)
    if rule.min is not None:
        ok = ok & (F.col("page_id") >= rule.min)
    if rule.max is not None:
        ok = ok & (F.col("page_id") <= rule.max)
    for a, b in rule.exclude:
        ok = ok & ~F.col("page_id").between(a, b)
    return ok


def _hit(rule: Rule, k: int, line: Column, base: Column) -> Column:
    """What the rule finds in ``line``, whose first character is at ``base`` of the page; null if nothing.

    ``taken``: characters of the line that the match uses up; ``kept``: whether it makes a point.
    """
    pattern = for_java(rule.source())
    whole = F.regexp_extract(line, pattern.source, 0)
    names: dict[str, list[int]] = {}
    for i, _, name in pattern.groups:
        names.setdefault(name, []).append(i)
    part = lambda i: F.regexp_extract(line, pattern.source, i)
    content = part(names["_content"][0]) if "_content" in names else None
    offset = F.length(whole) - F.length(content) if content is not None else F.lit(0)
    at = F.length(line) - F.length(whole) if rule.kind == "lineEndsWith" else F.lit(0)
    word = F.coalesce(*[F.when(part(i) != "", int(n[2:])) for n, ix in names.items() if n.startswith("_r") for i in ix], F.lit(0))
    own = {n: F.coalesce(*[F.nullif(part(i), F.lit("")) for i in ix]) for n, ix in names.items() if not n.startswith("_")}
    pairs = [(F.lit(n), F.lit(v)) for n, v in rule.meta.items() if n not in own] + [(F.lit(n), F.coalesce(c, F.lit(rule.meta.get(n)))) for n, c in own.items()]
    local = base + at + (F.length(whole) if rule.split == "after" else F.lit(0))
    return F.when(
        line.rlike(pattern.source),
        F.struct(local.cast("int").alias("local"), F.lit(k).alias("ord"), offset.cast("int").alias("offset"), F.lit(None).cast("string").alias("captured"), _map(pairs).alias("meta"), word.cast("int").alias("word"), _ids(rule).alias("kept"), (at + F.length(whole)).cast("int").alias("taken"), F.length(whole).alias("size")),
    )


def native_marks(rules: tuple[Rule, ...]) -> Column:
    """The marks of line-native rules in a page's text, as an array: at a line's start the first rule that matches, then at its end."""

    ends = [(k, r) for k, r in enumerate(rules) if r.kind == "lineEndsWith"]

    def at_start(line: Column, local: Column) -> Column:
        return F.coalesce(*[_hit(r, k, line, local) for k, r in enumerate(rules) if r.kind != "lineEndsWith"])

    def at_end(rest: Column, base: Column) -> Column:
        """Leftmost of all end matches is the longest; equals go to the earlier rule."""
        ranked = F.array_compact(F.array(*[bound(_hit(r, k, rest, base), lambda h: F.when(h.isNotNull(), F.struct((-h["size"]).alias("by"), h["ord"].alias("then"), h.alias("hit")))) for k, r in ends]))
        first = lambda a, b: F.when((a["by"] < b["by"]) | (a["by"] == b["by"]) & (a["then"] < b["then"]), a).otherwise(b)
        return bound(ranked, lambda r: F.aggregate(r, F.get(r, 0), first)["hit"])

    def of_line(line: Column, local: Column) -> Column:
        if not ends:
            return F.array(at_start(line, local))
        if len(ends) == len(rules):
            return F.array(at_end(line, local))

        def both(start: Column) -> Column:
            taken = F.coalesce(start["taken"], F.lit(0))
            return F.array(start, at_end(F.substring(line, taken + 1, F.length(line)), local + taken))

        return bound(at_start(line, local), both)

    hits = F.flatten(F.transform(lines_of("content"), lambda z: of_line(z["line"], z["local"])))
    return F.transform(F.filter(hits, lambda h: F.coalesce(h["kept"], F.lit(False))), lambda h: F.struct(*[h[f].alias(f) for f in ("local", "ord", "offset", "captured", "meta", "word")]))


def native_points(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Points of line-native rules."""
    return pages.select("book_id", "page_seq", F.explode(native_marks(rules)).alias("mark")).select("book_id", "page_seq", "mark.*")


def scanned_points(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Points of any rules; each book's text is joined in a worker and only points return."""
    arrow = pa.schema([("book_id", pa.string()), ("page_seq", pa.int64()), ("local", pa.int32()), ("ord", pa.int32()), ("offset", pa.int32()), ("captured", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("word", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("page_seq")
        seqs = table["page_seq"].to_pylist()
        book = Book(table["page_id"].to_pylist(), table["content"].to_pylist())
        name = table["book_id"][0].as_py()
        rows = [{"book_id": name, "page_seq": seqs[p.page], "local": p.local, "ord": p.rule, "offset": p.offset, "captured": p.captured, "meta": list((p.meta or {}).items()), "word": p.word} for p in Scanner(rules).points(book)]
        return pa.Table.from_pylist(rows, arrow)

    return pages.select("book_id", "page_seq", "page_id", "content").groupBy("book_id").applyInArrow(run, POINT)


def split_points(pages: DataFrame, options: Options) -> DataFrame:
    """All rules' points, each rule's first or last only where it says so."""
    rules = options.rules
    if not rules:
        return pages.sparkSession.createDataFrame([], POINT)
    points = native_points(pages, rules) if all(map(line_native, rules)) else scanned_points(pages, rules)
    for way in ("first", "last"):
        ords = [k for k, r in enumerate(rules) if r.occurrence == way]
        if ords:
            order = [F.asc("page_seq"), F.asc("local")] if way == "first" else [F.desc("page_seq"), F.desc("local")]
            points = points.withColumn("qw_nth", F.row_number().over(W.partitionBy("book_id", "ord").orderBy(*order))).where(~F.col("ord").isin(ords) | (F.col("qw_nth") == 1)).drop("qw_nth")
    return points


def merged_points(points: DataFrame) -> DataFrame:
    """One point per place: rules in order, metadata united (later wins), the first point's content kept
    unless a later one strips a marker or has metadata where it has none."""
    listed = points.groupBy("book_id", "page_seq", "local").agg(F.array_sort(F.collect_list(F.struct("ord", "offset", "captured", F.map_entries("meta").alias("meta"), "word"))).alias("all"))

    def better(a: Column, b: Column) -> Column:
        gains = ((b["offset"] > 0) & (a["offset"] == 0)) | ((F.size(b["meta"]) > 0) & (F.size(a["meta"]) == 0))
        return F.when(gains, b).otherwise(a)

    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    best = F.when(F.size("all") == 1, F.get("all", 0)).otherwise(F.aggregate(rest, F.get("all", 0), better))
    entries = F.flatten(F.transform("all", lambda p: p["meta"]))
    key_last = F.map_from_entries(_last_of(entries))
    return listed.select("book_id", "page_seq", "local", best.alias("p"), key_last.alias("meta")).select("book_id", "page_seq", "local", "p.ord", "p.offset", "p.captured", "meta", "p.word")


def _last_of(entries: Column) -> Column:
    """Map entries in which the last of equal keys stays."""
    return F.aggregate(
        entries, F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))),
    )


def cut(pages: DataFrame, points: DataFrame, options: Options) -> DataFrame:
    """book_id, seg_no, captured, offset, ord, word, meta, frags (page_seq, page_id, text in order), first_id."""
    marks = points.groupBy("book_id", "page_seq").agg(F.array_sort(F.collect_list(F.struct("local", "ord", "offset", "captured", F.map_entries("meta").alias("meta"), "word"))).alias("marks"))
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("local", "int"), ("ord", "int"), ("offset", "int"), ("captured", "string"), ("meta", "array<struct<key:string,value:string>>"), ("word", "int"))])
    joined = pages.join(marks, ["book_id", "page_seq"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<local:int,ord:int,offset:int,captured:string,meta:array<struct<key:string,value:string>>,word:int>>")))
    every = F.when((F.size("marks") > 0) & (F.get("marks", 0)["local"] == 0), F.col("marks")).otherwise(F.concat(F.array(none), F.col("marks")))
    parts = joined.select("book_id", "page_seq", "page_id", "content", every.alias("cuts")).select("book_id", "page_seq", "page_id", "content", "cuts", F.posexplode("cuts").alias("k", "c"))
    a = F.coalesce("c.local", F.lit(0))
    b = F.coalesce(F.get("cuts", F.col("k") + 1)["local"], F.length("content"))
    frags = parts.select("book_id", "page_seq", "page_id", "k", "c", F.substring(F.col("content"), a + 1, b - a).alias("text"))
    order = W.partitionBy("book_id").orderBy("page_seq", "k")
    numbered = frags.withColumn("seg_no", F.count("c.ord").over(order)).withColumn("first_id", F.first("page_id").over(order))
    segs = numbered.groupBy("book_id", "seg_no").agg(
        F.array_sort(F.collect_list(F.struct("page_seq", "k", "page_id", "text"))).alias("frags"), F.min_by("c", F.struct("page_seq", "k")).alias("c"), F.min("first_id").alias("first_id"),
    )
    return segs.select("book_id", "seg_no", "c.captured", F.coalesce("c.offset", F.lit(0)).alias("offset"), "c.ord", "c.word", F.map_from_entries(F.coalesce("c.meta", F.array().cast("array<struct<key:string,value:string>>"))).alias("meta"), "frags", "first_id")


def assembled(segs: DataFrame, options: Options) -> DataFrame:
    """Segments with their content and pages: book_id, seg_no, content, from_id, to_id, meta, ord, word, frags."""
    keep = F.lit(False)
    for r in options.rules:
        keep = keep | (F.coalesce(F.col("first_id") >= r.min if r.min is not None else F.lit(True), F.lit(True)) & (F.col("first_id") <= r.max if r.max is not None else F.lit(True)))
    if options.dictionary is not None:
        keep = F.lit(True)
    alone = F.max("seg_no").over(W.partitionBy("book_id")) == 0  # no point in the book: all of it is one segment
    kept = segs.withColumn("alone", alone).where((F.col("seg_no") > 0) | keep | F.col("alone"))
    skip = lambda f, i: F.when(i == 0, F.substring(f["text"], F.col("offset") + 1, F.length(f["text"]))).otherwise(f["text"])
    shown = F.transform("frags", lambda f, i: F.struct(f["page_seq"].alias("page_seq"), f["page_id"].alias("page_id"), skip(f, i).alias("text")))
    kept = kept.withColumn("shown", shown)
    kept = kept.withColumn("shown", F.when((F.size("shown") > 1) & (F.get("shown", 0)["text"] == ""), F.slice("shown", 2, F.size("shown"))).otherwise(F.col("shown")))
    joined = F.array_join(F.transform("shown", lambda f: f["text"]), options.glue)
    both = (F.col("offset") > 0) | (F.col("seg_no") == 0)
    content = F.when(F.col("captured").isNotNull(), X.trim_all("captured")).when(both, X.trim_all(joined)).otherwise(X.rtrim_all(joined))
    solid = F.filter("shown", lambda f: ~X.is_blank(f["text"]))
    first = F.when(both, F.get(solid, 0)["page_id"]).otherwise(F.get("shown", 0)["page_id"])
    out = kept.select("book_id", "seg_no", content.alias("content"), first.alias("from_id"), F.element_at(solid, -1)["page_id"].alias("last_id"), "meta", "ord", "word", "shown", "captured")
    return out.where(~X.is_blank("content")).select("book_id", "seg_no", "content", "from_id", F.nullif("last_id", "from_id").alias("to_id"), "meta", "ord", "word", F.when(F.col("captured").isNull(), F.col("shown")).otherwise(F.array(F.struct(F.get("shown", 0)["page_seq"].alias("page_seq"), F.col("from_id").alias("page_id"), F.col("captured").alias("text")))).alias("frags"))


def _page_only(options: Options) -> bool:
    """Are segments cut at page boundaries and nowhere else?"""
    first = options.breakpoints[0] if options.breakpoints else None
    plain = first is not None and first.source() is None and first.min is None and first.max is None and not first.skip_when
    return plain and options.max_pages is not None and options.max_content_length is None and not any(b.exclude for b in options.breakpoints)


def page_pieces(segs: DataFrame, options: Options) -> DataFrame:
    """Oversized segments by page: single pages as long as what is left spans more than ``maxPages``, then the rest.

    The first page from which the rest fits decides, so no page is looked at twice and nothing leaves the JVM.
    """
    last = F.element_at("frags", -1)["page_id"]
    fit = F.get(F.filter(F.transform("frags", lambda f, i: F.when(last - f["page_id"] <= options.max_pages, i)), lambda i: i.isNotNull()), 0)
    piece = lambda text, first, end: F.struct(X.trim_all(text).alias("content"), first.alias("from_id"), end.alias("last_id"))
    heads = F.transform(F.slice("frags", F.lit(1), F.col("fit")), lambda f: piece(f["text"], f["page_id"], f["page_id"]))
    rest = F.slice("frags", F.col("fit") + 1, F.size("frags"))
    solid = F.filter(rest, lambda f: ~X.is_blank(f["text"]))
    tail = piece(F.array_join(F.transform(rest, lambda f: f["text"]), options.glue), F.get(solid, 0)["page_id"], F.element_at(solid, -1)["page_id"])
    pieces = F.filter(F.concat(heads, F.array(tail)), lambda p: p["content"] != "")
    cutted = segs.withColumn("fit", fit).select("book_id", "seg_no", "meta", "ord", "word", F.posexplode(pieces).alias("piece", "p"))
    return cutted.select(
        "book_id", "seg_no", "p.content", "p.from_id", F.nullif("p.last_id", "p.from_id").alias("to_id"), "meta", "ord", "word", "piece", F.lit(0).alias("bp"), F.lit(None).cast("int").alias("bp_word"), F.lit(None).cast("string").alias("reason"),
    )


def rebroken(segs: DataFrame, options: Options) -> DataFrame:
    """Segments over the page or length limit cut at breakpoints: seg_no, piece and the rest as before.

    Segments that fit pass in the JVM, and so do all where pages are the only breakpoints; the others go to
    workers, each on its own.
    """
    if not options.limited:
        return segs.withColumn("piece", F.lit(0)).withColumns({"bp": F.lit(None).cast("int"), "bp_word": F.lit(None).cast("int"), "reason": F.lit(None).cast("string")})
    fits = F.lit(True)
    ids = F.transform("frags", lambda f: f["page_id"])
    if options.max_pages is not None:
        fits = fits & (F.coalesce("to_id", "from_id") - F.col("from_id") <= options.max_pages)
    if options.max_content_length is not None:
        fits = fits & (F.length("content") <= options.max_content_length)
    for b in options.breakpoints:
        for low, high in b.exclude:
            fits = fits & ~F.exists(ids, lambda i, low=low, high=high: i.between(low, high))
    extra = {"bp": F.lit(None).cast("int"), "bp_word": F.lit(None).cast("int"), "reason": F.lit(None).cast("string")}
    whole = segs.where(fits).withColumn("piece", F.lit(0)).withColumns(extra)
    columns = ["book_id", "seg_no", "piece", "content", "from_id", "to_id", "bp", "bp_word", "reason"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker = Breaker(options)
        for batch in batches:
            rows = []
            for book, seg, frags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pages = [f["page_id"] for f in frags]
                for n, p in enumerate(breaker.pieces(pages, [f["text"] for f in frags])):
                    first, last = pages[p.first], pages[p.last]
                    rows.append((book, seg, n, p.content, first, None if last == first else last, p.breakpoint, p.word, p.reason))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], columns)

    large = segs.where(~fits)
    if _page_only(options):
        back = page_pieces(large, options)
    else:
        cutted = large.select("book_id", "seg_no", "frags").mapInArrow(run, "book_id string, seg_no long, piece int, content string, from_id long, to_id long, bp int, bp_word int, reason string")
        back = cutted.join(large.select("book_id", "seg_no", "meta", "ord", "word"), ["book_id", "seg_no"])
    meta = F.when(F.col("piece") == 0, F.col("meta")).otherwise(F.create_map().cast(META))
    back = back.withColumn("meta", meta).withColumn("frags", F.lit(None).cast(segs.schema["frags"].dataType))
    return whole.unionByName(back)


SEGMENT = "book_id string, seg_seq int, content string, from_id long, to_id long, meta map<string,string>"
PROV = "struct<rule:struct<index:int,type:string,word:int>,breakpoint:struct<index:int,word:int>,length_reason:string>"


def segment_pages(pages: DataFrame, options: dict | Options) -> DataFrame:
    """book_id, seg_seq, content, from_id, to_id (null on one page), meta, and prov with ``debug``."""
    o = Options.of(options)
    ready = prepared(pages, o.preprocess)
    native, zones = all(map(line_native, o.rules)), None
    if o.dictionary is not None:
        from .lexicon import Finder, zoned

        zones = Finder(o.dictionary)
        ready = zoned(ready, o.dictionary)
    if native and o.rules:
        ready = ready.withColumn("marks", native_marks(o.rules))
    whole = not native or any(r.occurrence == "last" for r in o.rules)  # the book is held
    kinds = [r.kind for r in o.rules] + ["dictionary"]
    fields = [("book_id", pa.string()), ("seg_seq", pa.int32()), ("content", pa.string()), ("from_id", pa.int64()), ("to_id", pa.int64()), ("meta", pa.map_(pa.string(), pa.string()))]
    if o.debug:
        rule = pa.struct([("index", pa.int32()), ("type", pa.string()), ("word", pa.int32())])
        fields.append(("prov", pa.struct([("rule", rule), ("breakpoint", pa.struct([("index", pa.int32()), ("word", pa.int32())])), ("length_reason", pa.string())])))
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, scanner = Cutter(o), None if native else Scanner(o.rules)

        def marked(rows: Iterator[tuple]) -> Iterator[tuple]:
            """A book's pages with all their marks."""
            before, seen = None, set()
            for _, seq, page_id, content, *more in rows:
                marks = [Mark(m["local"], m["ord"], m["offset"], m["captured"], dict(m["meta"]), m["word"]) for m in more[-1]] if native and o.rules else []
                marks = [m for m in marks if o.rules[m.ord].occurrence != "first" or not (m.ord in seen or seen.add(m.ord))]
                if zones is not None:
                    marks += [Mark(at, len(o.rules), offset, None, meta) for at, offset, meta in zones.points(content, before, more[0])]
                    before = content
                yield seq, page_id, content, marks

        def pages_of(rows: Iterator[tuple]) -> Iterator[tuple]:
            if not whole:
                return marked(rows)
            held = list(marked(rows))
            if scanner is not None:
                for p in scanner.points(Book([p[1] for p in held], [p[2] for p in held])):
                    held[p.page][3].append(Mark(p.local, p.rule, p.offset, p.captured, p.meta, p.word))
            return once(held, o)

        def rows_of(name: str, found: Iterator[Segment]) -> Iterator[tuple]:
            for n, s in enumerate(found, 1):
                row = name, n, s.content, s.from_id, s.to_id, list(s.meta.items())
                yield (*row, {"rule": None if s.ord is None else {"index": s.ord, "type": kinds[s.ord], "word": s.word}, "breakpoint": {"index": s.bp, "word": s.bp_word}, "length_reason": s.reason}) if o.debug else row

        every = (row for name, rows in books(batches) for row in rows_of(name, cutter.segments((*p[:3], merged(p[3])) for p in pages_of(rows))))
        yield from batched(every, arrow, 2)

    return by_book(ready, "page_seq").mapInArrow(run, SEGMENT + (f", prov {PROV}" if o.debug else ""))
