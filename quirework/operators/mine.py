"""Mining: which openings lines have in common, and which sequences of tokens and words repeat."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dialect import SPACE, compile_python
from ..functions.templates import TOKENS
from .layout import batched, lines, parts

ORDER = "basmalah kitab bab fasl naql rumuz numbered raqms raqm dash bullet tarqim".split()
DELIMITERS = ":：-–—ـ،؛.?!؟()[]{}"
ARABIC_LETTER = regex.compile(r"(?=\p{L})\p{Script=Arabic}")
FIRST_WORD = regex.compile(rf"[^{SPACE}:،؛.?!؟]+")
PLAIN_WORD = regex.compile(rf"[^{SPACE}:：\-–—ـ،؛.?!؟()\[\]{{}}]+")
#: White space, then a word that no token can begin, if there is one: one call for most items.
QUICK = regex.compile(rf"[{SPACE}]*([^{SPACE}:：\-–—ـ،؛.?!؟()\[\]{{}}•*°\u0600-\u06FF\uFDFD][^{SPACE}:：\-–—ـ،؛.?!؟()\[\]{{}}]*)?")
BLANKS = regex.compile(r"[ \t]+")
MARK = regex.compile(X.DIACRITICS)
#: No token begins with anything else, which spares other scripts' words a dozen tries.
MAY_BEGIN = regex.compile(r"[\-–—•*°.!?\u0600-\u06FF\uFDFD]")
MAX_STEPS = 6
HEADING = ("^#+",)
SPACES_RUN = regex.compile(rf"[{SPACE}]+")
UNEVEN = re.compile(rf"  |[{SPACE.replace(' ', '')}]")


def literal(text: str) -> str:
    """Escape what a signature would read as a pattern; brackets stay as they are."""
    return text if text.isalnum() else "".join("\\" + c if c in ".*+?^${}|\\" else c for c in text)


@lru_cache(maxsize=1)
def _tokens():
    return [(t, compile_python(TOKENS[t]).regex) for t in ORDER]


def token_at(text: str, at: int) -> tuple[str, str] | None:
    """The longest token that begins here; of equals the one of higher priority."""
    if not MAY_BEGIN.match(text, at):
        return None
    best: tuple[str, str] | None = None
    for name, pattern in _tokens():
        m = pattern.match(text, at)
        if m and (best is None or len(m[0]) > len(best[1])):
            best = name, m[0]
    if best and best[0] == "rumuz":
        after = text[at + len(best[1]) : at + len(best[1]) + 1]
        if after and ARABIC_LETTER.match(after):
            return None
    return best


def signature(line: str, prefix_chars: int = 60, fallback: bool = True, strip_marks: bool = True, blank: str = r"\s*", prefixes: tuple[str, ...] = ("^#+",)) -> str | None:
    """A line's opening as a template: heading marks, tokens, delimiters, or its first word.

    At most ``MAX_STEPS`` tokens are taken; None if nothing but white space is there to describe.
    """
    text = (MARK.sub("", line) if strip_marks and not line.isascii() else line)[:prefix_chars]
    if prefixes == HEADING and text and text[0] not in " \t#" and not MAY_BEGIN.match(text):  # most lines open with a word
        word = FIRST_WORD.match(text) if fallback else None
        return literal(word[0]) if word else None
    out, at, steps, any_, token = "", 0, 0, False, False

    def space(out: str) -> str:
        return out + blank if out and not out.endswith(blank) else out

    for p in prefixes:
        m = regex.match(p, text)
        if m and m[0]:
            out, at, any_ = literal(m[0]), m.end(), True
            if b := BLANKS.match(text, at):
                out, at = space(out), b.end()
            break
    while steps < MAX_STEPS and at < len(text):
        if b := BLANKS.match(text, at):
            out, at = space(out), b.end()
            continue
        if found := token_at(text, at):
            out, at, steps, any_, token = f"{out}{{{{{found[0]}}}}}", at + len(found[1]), steps + 1, True, True
            continue
        if any_ and text[at] in DELIMITERS:
            out, at = out + literal(text[at]), at + 1
            continue
        if fallback and not token and (w := FIRST_WORD.match(text, at)):
            out, any_ = out + literal(w[0]), True
        break
    if not any_:
        return None
    while out.endswith(blank):
        out = out[: -len(blank)]
    return out


def stream(text: str, strip_marks: bool = True) -> list[dict]:
    """Tokens, delimiters and words of a text, with offsets in it as it is."""
    if strip_marks and MARK.search(text):
        kept = [i for i, c in enumerate(text) if not MARK.match(c)]
        plain = "".join(text[i] for i in kept)
        edges = [*kept, len(text)]
    else:
        plain, edges = text, range(len(text) + 1)
    out, at = [], 0
    while at < len(plain):
        quick = QUICK.match(plain, at)
        if word := quick[1]:
            a, b = edges[quick.start(1)], edges[quick.end()]
            out.append({"type": "literal", "text": literal(word), "raw": text[a:b], "start": a, "end": b})
            at = quick.end()
            continue
        if quick.end() > at:
            at = quick.end()
            continue
        found = token_at(plain, at)
        if found:
            size, kind, shown = len(found[1]), "token", f"{{{{{found[0]}}}}}"
        elif plain[at] in DELIMITERS:
            size, kind, shown = 1, "literal", literal(plain[at])
        elif w := PLAIN_WORD.match(plain, at):
            size, kind, shown = len(w[0]), "literal", literal(w[0])
        else:
            at += 1
            continue
        a, b = edges[at], edges[at + size]
        out.append({"type": kind, "text": shown, "raw": text[a:b], "start": a, "end": b})
        at += size
    return out


def _specificity(pattern: Column) -> list[Column]:
    tokens = F.regexp_count(pattern, F.lit(r"\{\{"))
    solid = F.length(F.regexp_replace(F.replace(pattern, F.lit(r"\s*"), F.lit("")), r"[ \t]+", ""))
    return [tokens.desc(), solid.desc()]


SIGNED = "book_id string, page_seq long, page_id long, line_no int, line string, pattern string"
SIGNED_ARROW = pa.schema([("book_id", pa.string()), ("page_seq", pa.int64()), ("page_id", pa.int64()), ("line_no", pa.int32()), ("line", pa.string()), ("pattern", pa.string())])


def _flat(line: str) -> str:
    """``text.collapse_whitespace`` of a line."""
    return (SPACES_RUN.sub(" ", line) if UNEVEN.search(line) else line).strip(X.SPACES)


def _signer(pages: DataFrame, min_line_length: int = 6, line_filter: Callable[[Column, Column], Column] | None = None, prefix_chars: int = 60, include_first_word: bool = True, strip_marks: bool = True, prefixes: tuple[str, ...] = HEADING, whitespace: str = "regex"):
    """What workers read, and what makes it rows of ``SIGNED``.  Lines are told apart there unless a filter wants them as columns."""
    blank = " " if whitespace == "space" else r"\s*"
    sign = lambda t: signature(t, prefix_chars, include_first_word, strip_marks, blank, prefixes)
    if line_filter is not None:
        flat = lines(pages).withColumn("line", X.collapse_whitespace("line")).where(F.length("line") >= min_line_length).where(line_filter(F.col("line"), F.col("page_id")))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for part in parts(batches):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (pattern := sign(row[4])) is not None:
                        yield (*row, pattern)

        return flat.select("book_id", "page_seq", "page_id", "line_no", "line"), rows

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts(batches):
            for book, seq, page_id, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for n, raw in enumerate((content or "").split("\n")):
                    line = _flat(raw)
                    if len(line) >= min_line_length and (pattern := sign(line)) is not None:
                        yield book, seq, page_id, n, line, pattern

    return pages.select("book_id", "page_seq", "page_id", "content"), split


def line_signatures(pages: DataFrame, **options) -> DataFrame:
    """book_id, page_seq, page_id, line_no, line (collapsed), pattern, for each line long enough; narrow."""
    source, rows = _signer(pages, **options)
    return source.mapInArrow(lambda batches: batched(rows(batches), SIGNED_ARROW, 4), SIGNED)


#: Patterns that a worker holds with their counts before it sends them.
HELD_PATTERNS = 1 << 16


def _first_lines(pages: DataFrame, **options) -> DataFrame:
    """Rows of patterns with a count and the first of their places, so many lines as one: what is shuffled is a row for each pattern of a worker."""
    source, rows = _signer(pages, **options)
    schema = SIGNED_ARROW.append(pa.field("count", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[str, list] = {}
        for book, seq, page_id, n, line, pattern in rows(batches):
            place = (book is not None, book or "", seq, n)
            known = held.get(pattern)
            if known is None:
                if len(held) >= HELD_PATTERNS:
                    yield from ((*first, p, count) for p, (count, _, first) in held.items())
                    held = {}
                held[pattern] = [1, place, (book, seq, page_id, n, line)]
            else:
                known[0] += 1
                if place < known[1]:
                    known[1:] = place, (book, seq, page_id, n, line)
        yield from ((*first, p, count) for p, (count, _, first) in held.items())

    return source.mapInArrow(lambda batches: batched(run(batches), schema, 4), f"{SIGNED}, count long")


def common_line_starts(pages: DataFrame, min_count: int = 3, top_k: int = 40, max_examples: int = 1, sort_by: str = "specificity", **options) -> DataFrame:
    """pattern, count, examples (the first of them) of the most telling line openings.

    Counts combine in the workers; examples are the smallest places, kept as a running minimum when one is
    asked for, so a common opening's lines are never gathered.
    """
    place = F.struct("book_id", "page_seq", "line_no", "page_id", "line")
    if max_examples == 1:
        counted = _first_lines(pages, **options).groupBy("pattern").agg(F.sum("count").alias("count"), F.array(F.min(place)).alias("examples"))
    else:
        marks = line_signatures(pages, **options)
        nth = F.row_number().over(W.partitionBy("pattern").orderBy("book_id", "page_seq", "line_no"))
        firsts = marks.withColumn("nth", nth).where(F.col("nth") <= max_examples).groupBy("pattern").agg(F.array_sort(F.collect_list(place)).alias("examples"))
        counted = marks.groupBy("pattern").agg(F.count(F.lit(1)).alias("count")).join(firsts, "pattern")
    order = [*_specificity(F.col("pattern")), F.desc("count"), F.asc("pattern")]
    if sort_by == "count":
        order = [F.desc("count"), *order[:2], F.asc("pattern")]
    shown = F.transform("examples", lambda e: F.struct(e["line"].alias("line"), e["page_id"].alias("page_id")))
    return counted.where(F.col("count") >= min_count).orderBy(*order).limit(top_k).select("pattern", "count", shown.alias("examples"))


ITEMS = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def token_streams(pages: DataFrame, strip_marks: bool = True) -> DataFrame:
    """book_id, page_seq, page_id, content, items; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[{k: i[k] for k in ("type", "text", "start", "end")} for i in stream(t.as_py() or "", strip_marks)] for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(items, ITEMS)], ["book_id", "page_seq", "page_id", "content", "items"])

    return pages.select("book_id", "page_seq", "page_id", "content").mapInArrow(run, "book_id string, page_seq long, page_id long, content string, items array<struct<type:string,text:string,start:int,end:int>>")


GRAM = "pattern string, n int, count long, token_count int, literal_length int, book_id string, page_seq long, page_id long, i int"
#: Pages are counted together up to so many items; a longer page is counted on its own.
SLICE_ITEMS = 1 << 18
NOT_LATIN = regex.compile(r"[\u0600-\u06FF\uFDFD]")
#: The items of a text without Arabic letters or signs, where only single characters are tokens.
ITEM = re.compile(rf"[•*°{re.escape(DELIMITERS)}]|[^{SPACE}{re.escape(DELIMITERS)}]+")
SINGLE = dict.fromkeys("-–—", "dash") | dict.fromkeys("•*°", "bullet") | dict.fromkeys(".!?", "tarqim")


class _Codes(dict):
    """A number for each item as it is shown, found by what the text has."""

    def __init__(self) -> None:
        self.shown: dict[tuple[str, bool], int] = {}

    def of(self, text: str, token: bool) -> int:
        return self.shown.setdefault((text, token), len(self.shown))

    def __missing__(self, raw: str) -> int:
        name = SINGLE.get(raw)
        self[raw] = self.of(f"{{{{{name}}}}}", True) if name else self.of(literal(raw), False)
        return self[raw]

    def items(self, text: str, strip_marks: bool) -> list[int]:
        if not NOT_LATIN.search(text):
            return [self[raw] for raw in ITEM.findall(text)]
        return [self.of(x["text"], x["type"] == "token") for x in stream(text, strip_marks)]


class _Slice:
    """Item streams of some pages in reading order, as codes; n-grams are counted on arrays, in time linear in the items."""

    def __init__(self, pages: list[tuple], codes: _Codes):
        pages = sorted(pages, key=lambda p: p[:2])
        self.keys = [pa.array([p[k] for p in pages], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        sizes = np.array([len(p[3]) for p in pages], np.int64)
        self.codes = np.fromiter(chain.from_iterable(p[3] for p in pages), np.int64, int(sizes.sum()))
        self.page, self.first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        self.texts = pa.array([t for t, _ in codes.shown], pa.string())
        token = np.array([k for _, k in codes.shown], bool)
        solid = np.where(token, 0, [len(t) for t, _ in codes.shown])
        self.tokens, self.solid = (np.concatenate([[0], np.cumsum(x[self.codes])]) for x in (token, solid))

    def places(self, low: int, high: int, require_token: bool) -> Iterator[tuple[int, np.ndarray]]:
        """n, and where n items lie on one page."""
        for n in range(low, high + 1):
            m = len(self.codes) - n + 1
            if m < 1:
                return
            whole = self.page[:m] == self.page[n - 1 :]
            if require_token:
                whole &= self.tokens[n:] > self.tokens[:m]
            yield n, np.flatnonzero(whole)

    def _order(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the order of patterns, where each pattern begins among them, and how many it has."""
        ids = self.codes[at]
        for k in range(1, n):
            _, ids = np.unique(ids * len(self.texts) + self.codes[at + k], return_inverse=True)
        by = np.argsort(ids, kind="stable")
        edges = np.flatnonzero(np.diff(ids[by], prepend=-1))
        return at[by], edges, np.diff(np.append(edges, len(at)))

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """64 bits of each pattern that begins at ``at``, the same wherever it occurs."""
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            out = (out ^ self.item_hashes[self.codes[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    @cached_property
    def item_hashes(self) -> np.ndarray:
        return np.array([int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest()) for t in self.texts.to_pylist()], np.uint64)

    def grams(self, low: int, high: int, glue: str, require_token: bool, examples: int, keep: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """A row for each pattern's first ``examples`` places; the first of them has its count, the others 0.  ``keep``: only these patterns' hashes, in order."""
        for n, at in self.places(low, high, require_token):
            if keep is not None:
                at = at[_among(self.hashes(at, n), keep)]
            order, edges, counts = self._order(at, n)
            for k in range(examples):
                more = counts > k
                if more.any():
                    yield self._rows(order[edges[more] + k], n, counts[more] if k == 0 else np.zeros(more.sum(), np.int64), glue)

    def sums(self, low: int, high: int, require_token: bool) -> tuple[np.ndarray, np.ndarray]:
        """Patterns' hashes and counts."""
        found = [np.unique(self.hashes(at, n), return_counts=True) for n, at in self.places(low, high, require_token)]
        return _summed([h for h, _ in found], [c for _, c in found])

    def _rows(self, at: np.ndarray, n: int, counts: np.ndarray, glue: str) -> pa.RecordBatch:
        pattern = pc.binary_join_element_wise(*[self.texts.take(pa.array(self.codes[at + k])) for k in range(n)], glue) if n > 1 else self.texts.take(pa.array(self.codes[at]))
        page = self.page[at]
        ints = [pa.array(x.astype(np.int32)) for x in (self.tokens[at + n] - self.tokens[at], self.solid[at + n] - self.solid[at])]
        keys = [k.take(pa.array(page)) for k in self.keys]
        columns = [pattern, pa.array(np.full(len(at), n, np.int32)), pa.array(counts), *ints, *keys, pa.array((at - self.first[page]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in GRAM.split(", ")])


def _among(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``keep``, which is in order: most are told by 16 of their bits."""
    if not len(keep):
        return np.zeros(len(values), bool)
    low = np.zeros(1 << 16, bool)
    low[keep & 0xFFFF] = True
    out = low[values & 0xFFFF]
    some = values[out]
    out[out] = keep[np.minimum(np.searchsorted(keep, some), len(keep) - 1)] == some
    return out


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, with its counts' sum."""
    all_, each = np.concatenate([np.empty(0, np.int64), *hashes]), np.concatenate([np.empty(0, np.int64), *counts])
    order = np.argsort(all_, kind="stable")
    all_, each = all_[order], each[order]
    edges = np.flatnonzero(np.diff(all_, prepend=~all_[:1]))
    return all_[edges], np.add.reduceat(each, edges) if len(edges) else each


def _slices(batches: Iterator[pa.RecordBatch], low: int, strip_marks: bool) -> Iterator[_Slice]:
    held: list[tuple] = []
    codes, size = _Codes(), 0
    for batch in batches:
        names, seqs, ids = (batch.column(k).to_pylist() for k in range(3))
        for book, seq, page_id, content in zip(names, seqs, ids, batch.column(3), strict=True):
            items = codes.items(content.as_py() or "", strip_marks)
            if len(items) >= low:
                held.append((book, seq, page_id, items))
                size += len(items)
            if size >= SLICE_ITEMS:
                yield _Slice(held, codes)
                held, codes, size = [], _Codes(), 0
    if held:
        yield _Slice(held, codes)


def _grams(pages: DataFrame, low: int, high: int, glue: str, require_token: bool, examples: int, strip_marks: bool, keep: np.ndarray | None = None) -> DataFrame:
    """n-grams counted slice by slice in the workers, so what is shuffled is a row for each pattern of a slice and not for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, low, strip_marks):
            yield from part.grams(low, high, glue, require_token, examples, keep)

    return pages.select("book_id", "page_seq", "page_id", "content").mapInArrow(run, GRAM)


#: Sums that a worker holds before it sends them, and patterns beyond ``top_k`` that are told to the driver.
HELD_SUMS, MORE = 1 << 21, 10_000


def _often(pages: DataFrame, low: int, high: int, require_token: bool, strip_marks: bool, min_count: int, top_k: int) -> np.ndarray | None:
    """Hashes of the patterns that may be among the ``top_k`` most frequent, in order; None if they are too many.

    Only hashes and numbers are shuffled.  A hash counts at least as often as each of its patterns, and every hash that counts as often
    as the last of ``top_k`` is there, so no pattern is missed as long as no two share one of them, which the caller sees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda h, n: pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["hash", "count"])
        hashes, counts, size = [], [], 0
        for part in _slices(batches, low, strip_marks):
            h, n = part.sums(low, high, require_token)
            hashes, counts, size = [*hashes, h], [*counts, n], size + len(h)
            if size >= HELD_SUMS:
                h, n = _summed(hashes, counts)
                if len(h) >= HELD_SUMS // 2:
                    yield rows(h, n)
                    h, n = h[:0], n[:0]
                hashes, counts, size = [h], [n], len(h)
        yield rows(*_summed(hashes, counts))

    sums = pages.select("book_id", "page_seq", "page_id", "content").mapInArrow(run, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))
    top = sums.where(F.col("count") >= min_count).orderBy(F.desc("count")).limit(top_k + MORE).collect()  # ``top_k + MORE`` numbers
    least = top[top_k - 1]["count"] if len(top) >= top_k else min_count
    if len(top) == top_k + MORE and top[-1]["count"] == least:
        return None
    return np.array(sorted(r["hash"] for r in top if r["count"] >= least), np.int64)


def _shown(places: DataFrame, pages: DataFrame, context_chars: int, strip_marks: bool) -> DataFrame:
    """``places`` (pattern, nth, book_id, page_seq, page_id, i, n; a few) with text, context and start from their pages."""
    found = pages.select("book_id", "page_seq", "content").join(F.broadcast(places), ["book_id", "page_seq"])  # top_k * max_examples rows
    names = ["pattern", "nth", "page_id", "text", "context", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pattern, nth, page_id, i, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items = stream(text, strip_marks)
                start, end = items[i]["start"], items[i + n - 1]["end"]
                a, b = max(0, start - context_chars), min(len(text), end + context_chars)
                out.append((pattern, nth, page_id, text[start:end], ("..." if a else "") + text[a:b] + ("..." if b < len(text) else ""), start))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names)

    return found.select("pattern", "nth", "page_id", "i", "n", "content").mapInArrow(run, "pattern string, nth int, page_id long, text string, context string, start int")


def repeating_sequences(
    pages: DataFrame, min_elements: int = 1, max_elements: int = 3, min_count: int = 3, top_k: int = 20, require_token: bool = True, whitespace: str = "regex",
    max_examples: int = 3, context_chars: int = 50, max_unique_patterns: int | None = 1000, strip_marks: bool = True,
) -> DataFrame:
    """pattern, count, token_count, literal_length, examples of the most frequent n-grams of items.

    ``max_unique_patterns`` keeps the patterns seen first, as many as that, with exact counts and exact first
    places; None keeps all.  Then patterns are counted by hashes first, at once, and only those that may be among
    the ``top_k`` are counted again as they are.

    One example is the running minimum of the places, taken in the same aggregate as the counts; more take
    a second pass, which keeps each slice's first few places of the ``top_k`` patterns.  Examples' texts are
    read from their pages at the end.
    """
    glue = " " if whitespace == "space" else r"\s*"
    low, high = max(1, min_elements), max(max(1, min_elements), max_elements)
    keep = _often(pages, low, high, require_token, strip_marks, min_count, top_k) if max_unique_patterns is None else None
    grams = lambda examples: _grams(pages, low, high, glue, require_token, examples, strip_marks, keep)
    place = ["book_id", "page_seq", "i", "n", "page_id"]
    counted = lambda: grams(1).groupBy("pattern").agg(F.sum("count").alias("count"), F.min(F.struct(*place)).alias("seen"), F.min("token_count").alias("token_count"), F.min("literal_length").alias("literal_length"))
    stats = counted()
    if keep is not None:
        found = stats.collect()  # ``top_k + MORE`` rows, and one more for each pattern that shares a hash
        stats = pages.sparkSession.createDataFrame(found, stats.schema)
        if len(found) > len(keep):
            keep = None
            stats = counted()
    if max_unique_patterns is not None:
        stats = stats.orderBy("seen").limit(max_unique_patterns)
    top = stats.where(F.col("count") >= min_count).orderBy(F.desc("count"), F.desc("token_count"), F.desc("literal_length"), F.asc("seen")).limit(top_k)
    if max_examples < 1:
        return top.select("pattern", "count", "token_count", "literal_length", F.array().cast("array<struct<page_id:long,text:string,context:string,start:int>>").alias("examples"))
    if max_examples == 1:
        places = top.select("pattern", F.lit(1).alias("nth"), "seen.*")
    else:
        nth = F.row_number().over(W.partitionBy("pattern").orderBy("book_id", "page_seq", "i", "n"))
        places = grams(max_examples).join(F.broadcast(top.select("pattern")), "pattern").withColumn("nth", nth).where(F.col("nth") <= max_examples).select("pattern", "nth", *place)  # top_k rows
    e = F.struct("nth", F.struct("page_id", "text", "context", "start").alias("e"))
    examples = _shown(places, pages, context_chars, strip_marks).groupBy("pattern").agg(F.array_sort(F.collect_list(e)).alias("es")).select("pattern", F.transform("es", lambda x: x["e"]).alias("examples"))
    return top.join(examples, "pattern").select("pattern", "count", "token_count", "literal_length", "examples")
