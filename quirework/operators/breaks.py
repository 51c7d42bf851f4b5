"""Cutting an oversized segment again at preferred places: a pure function of its pages and the options.

Pages' offsets within the segment are exact, as they are carried from the cut, so page boundaries are
never searched for in the text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from ..functions.dialect import SPACE, compile_python
from ..functions.text import SPACES
from ..plans.config import Options

LOOK_BACK = 100
UNLIMITED = 1 << 62
JOINERS = "‌‍"


@dataclass
class Piece:
    content: str
    first: int
    last: int
    breakpoint: int | None = None
    word: int | None = None
    reason: str | None = None


def _mark(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c).startswith("M") or c in "︎️"


def unicode_safe(text: str, at: int) -> int:
    """``at`` or the nearest place before it where no mark, selector or joiner is torn off."""
    while 0 < at < len(text) and (_mark(text[at]) or text[at] in JOINERS or text[at - 1] in JOINERS):
        at -= 1
    return at


class Breaker:
    def __init__(self, options: Options):
        import regex

        self.o = options
        self.space = regex.compile(f"[{SPACE}]+")
        self.stop = regex.compile(rf"[{SPACE}.,;!?؛،۔۝۞]")
        self.patterns = [None if b.source() is None else compile_python(b.source()) for b in options.breakpoints]
        self.skips = [compile_python(b.skip_when).regex if b.skip_when else None for b in options.breakpoints]
        self.pages = options.max_pages if options.max_pages is not None else UNLIMITED
        self.excludes = any(b.exclude for b in options.breakpoints)
        self.most = options.max_content_length

    def excluded(self, page_id: int) -> bool:
        return any(b.excludes(page_id) for b in self.o.breakpoints)

    def pieces(self, ids: list[int], texts: list[str]) -> list[Piece]:
        """Pieces in order; ``first`` and ``last`` index the pages they lie on.

        No step copies or looks at more of the text or the pages than its own piece may span.
        """
        raw = "\n".join(texts)
        text = raw.strip(SPACES)
        lead = raw.find(text) if text else 0
        starts, at = [], -lead
        for t in texts:
            starts.append(min(max(0, at), len(text)))  # blank pages at the end begin where the text ends
            at += len(t) + 1
        bounds = [*starts, len(text)]
        out: list[Piece] = []
        cursor, last_break, last = 0, (None, None), len(ids) - 1
        stops = [k for k, i in enumerate(ids) if self.excluded(i)] if self.excludes else []
        while cursor < len(text):
            page, left = self._page(starts, cursor), len(text) - cursor
            if ids[last] - ids[page] <= self.pages and (self.most is None or left <= self.most) and not (stops and stops[-1] >= page):
                self._emit(out, text, starts, cursor, len(text), last_break, None)
                break
            page_end = bounds[page + 1] - cursor
            if self.pages == 0 and self.most and page < last:
                own = text[cursor : cursor + page_end].strip(SPACES)
                if own and len(own) <= self.most and not self.excluded(ids[page]):
                    boundary = next((i for i, p in enumerate(self.patterns) if p is None), last_break[0])
                    last_break = (boundary, None)
                    self._emit(out, text, starts, cursor, cursor + page_end, last_break, None)
                    cursor = self._skip(text, cursor + page_end)
                    continue
            window = last if self.pages == UNLIMITED else page
            while window < last and ids[window + 1] <= ids[page] + self.pages:
                window += 1
            width = page_end if self.pages == 0 else bounds[window + 1] - cursor
            width = min(width, self.most or width, left)
            size, index, word, reason = self._find(ids, bounds, text, cursor, page, window, last, width, stops)
            if index is not None:
                last_break = (index, word)
            if size <= 0:
                size = max(1, min(self.most, left) if self.most else 1)
            self._emit(out, text, starts, cursor, cursor + size, last_break, reason)
            cursor = self._skip(text, cursor + size)
        return out

    def _page(self, starts: list[int], at: int) -> int:
        return max(0, bisect_right(starts, at) - 1)

    def _skip(self, text: str, at: int) -> int:
        found = self.space.match(text, at)
        return found.end() if found else at

    def _emit(self, out: list[Piece], text: str, starts: list[int], a: int, b: int, last_break, reason: str | None) -> None:
        while a < b and self.space.match(text[a]):
            a += 1
        while b > a and self.space.match(text[b - 1]):
            b -= 1
        if a == b:
            return
        first, last = self._page(starts, a), self._page(starts, b - 1)
        content, at = "", a
        for p in range(first + 1, last + 1):  # the line breaks between pages become the joiner
            edge = starts[p]
            if a < edge <= b and text[edge - 1] == "\n":
                content, at = content + text[at : edge - 1] + self.o.glue, edge
        out.append(Piece(content + text[at:b], first, last, last_break[0], last_break[1], reason))

    def _find(self, ids, bounds, text: str, cursor: int, page: int, window: int, last: int, width: int, stops: list[int]):
        """(length of the piece, breakpoint, word, reason)."""
        if stops:
            k = bisect_left(stops, page)
            if k < len(stops) and stops[k] == page and page < last:
                return bounds[page + 1] - cursor, None, None, None
            k += k < len(stops) and stops[k] == page
            if k < len(stops) and stops[k] <= window:
                return bounds[stops[k]] - cursor, None, None, None
        rest = text[cursor : cursor + max(width, 0) + 1]  # patterns see what comes before the piece as little as what comes after its window
        by_length = self.most is not None and width == self.most
        for i, (b, pattern, skip) in enumerate(zip(self.o.breakpoints, self.patterns, self.skips, strict=True)):
            if not b.allows(ids[page]) or b.exclude and any(map(b.excludes, ids[page : window + 1])) or skip is not None and skip.search(text[cursor:]):
                continue
            if pattern is None:
                edge = bounds[page + 1] - cursor
                if not by_length and page < last and 0 < edge <= width:
                    return edge, i, None, None
                size, reason = self._safe(rest, width)
                return size, i, None, reason if by_length else None
            best = None
            for m in pattern.regex.finditer(rest, 0, width):
                size = m.start() if b.split == "at" else m.end()
                if m.end() > m.start() and size > 0:
                    best = m, size
                    if self.o.prefer == "shorter":
                        break
            if best:
                word = next((int(n[2:]) for g, _, n in pattern.groups if n.startswith("_w") and best[0].start(g) >= 0), None)
                return best[1], i, word, None
        size, reason = self._safe(rest, width)
        return size, None, None, reason if by_length else None

    def _safe(self, rest: str, width: int) -> tuple[int, str | None]:
        if width >= len(rest):
            return width, None
        for at in range(width - 1, max(0, width - LOOK_BACK) - 1, -1):
            if self.stop.match(rest[at]):
                return at + 1, "whitespace"
        return unicode_safe(rest, width), "unicode_boundary"
