"""Cutting one book: its pages with their marks to segments, in one go through the pages.

The same steps as ``segment.merged_points``, ``cut``, ``assembled`` and ``rebroken`` have as columns; here a worker
takes a book's pages one by one, holds no more of them than the segment that it is in, and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from ..functions.text import SPACES
from ..plans.config import Options
from .breaks import Breaker


class Mark(NamedTuple):
    local: int
    ord: int
    offset: int = 0
    captured: str | None = None
    meta: dict[str, str] | None = None
    word: int | None = None


class Segment(NamedTuple):
    content: str
    from_id: int | None
    to_id: int | None
    meta: dict[str, str]
    ord: int | None
    word: int | None
    bp: int | None = None
    bp_word: int | None = None
    reason: str | None = None


#: page_seq, page_id, text, marks
Page = tuple[int, int, str, list[Mark]]
NOTHING = Mark(0, -1)


def merged(marks: list[Mark]) -> list[Mark]:
    """One mark per place, in order: see ``segment.merged_points``."""
    if len(marks) < 2:
        return marks
    marks = sorted(marks, key=lambda m: (m.local, m.ord, m.offset, m.captured is not None, m.captured or "", list((m.meta or {}).items())))
    out: list[Mark] = []
    for m in marks:
        if not out or out[-1].local != m.local:
            out.append(m)
            continue
        best, metas = out[-1], dict(out[-1].meta or {})
        for k, v in (m.meta or {}).items():
            metas.pop(k, None)
            metas[k] = v
        if m.offset > 0 and best.offset == 0 or m.meta and not best.meta:
            best = m
        out[-1] = best._replace(meta=metas)
    return out


def once(pages: list[Page], options: Options) -> list[Page]:
    """``pages`` without the marks of rules that count only at their first or last place in the book."""
    for k, rule in enumerate(options.rules):
        if rule.occurrence != "all":
            places = [(n, m.local) for n, p in enumerate(pages) for m in p[3] if m.ord == k]
            if places:
                the = min(places) if rule.occurrence == "first" else max(places)
                pages = [(*p[:3], [m for m in p[3] if m.ord != k or (n, m.local) == the]) for n, p in enumerate(pages)]
    return pages


class Cutter:
    def __init__(self, options: Options):
        self.o = options
        self.breaker = Breaker(options)
        first = options.breakpoints[0] if options.breakpoints else None
        plain = first is not None and first.source() is None and first.min is None and first.max is None and not first.skip_when
        #: Are segments cut at page boundaries and nowhere else?
        self.page_only = plain and options.max_pages is not None and options.max_content_length is None and not any(b.exclude for b in options.breakpoints)

    def segments(self, pages: Iterable[Page]) -> Iterator[Segment]:
        for seg, frags in self._whole(pages):
            yield from self._limited(seg, frags)

    def _whole(self, pages: Iterable[Page]) -> Iterator[tuple[Segment, list]]:
        head, frags, first_id, start = NOTHING, [], None, True
        for seq, page_id, text, marks in pages:
            if start:
                first_id, start = page_id, False
            edge = marks[0].local if marks else len(text)
            if edge or not marks:
                frags.append((page_id, text[:edge]))
            for k, m in enumerate(marks):
                if frags and (head is not NOTHING or self._opens(first_id)) and (made := self._made(head, frags)):
                    yield made
                head = m
                frags = [(page_id, text[m.local : marks[k + 1].local if k + 1 < len(marks) else len(text)])]
        if frags and (made := self._made(head, frags)):  # a book without marks is one segment
            yield made

    def _opens(self, first_id: int | None) -> bool:
        """Is the text before the first mark kept?"""
        return self.o.dictionary is not None or any((r.min is None or first_id is None or first_id >= r.min) and (r.max is None or first_id is not None and first_id <= r.max) for r in self.o.rules)

    def _made(self, head: Mark, frags: list[tuple[int, str]]) -> tuple[Segment, list] | None:
        if head.offset:
            frags[0] = (frags[0][0], frags[0][1][head.offset :])
        if len(frags) > 1 and frags[0][1] == "":
            frags = frags[1:]
        both = head.offset > 0 or head is NOTHING
        if head.captured is not None:
            content = head.captured.strip(SPACES)
        else:
            content = frags[0][1] if len(frags) == 1 else self.o.glue.join([t for _, t in frags])
            content = content.strip(SPACES) if both else content.rstrip(SPACES)
        if not content.strip(SPACES):
            return None
        solid = [i for i, t in (frags if both else frags[1:]) if t.strip(SPACES)]
        first = (solid[0] if solid else None) if both else frags[0][0]
        last = solid[-1] if solid else frags[0][0] if frags[0][1].strip(SPACES) else None
        ord_, word = (None, None) if head is NOTHING else (head.ord, head.word)
        return Segment(content, first, None if last == first else last, head.meta or {}, ord_, word), frags if head.captured is None else [(first, head.captured)]

    def _fits(self, seg: Segment, frags: list[tuple[int, str]]) -> bool:
        o = self.o
        if o.max_pages is not None and seg.to_id is not None and seg.from_id is not None and seg.to_id - seg.from_id > o.max_pages:
            return False
        if o.max_content_length is not None and len(seg.content) > o.max_content_length:
            return False
        return not any(b.excludes(i) for b in o.breakpoints if b.exclude for i, _ in frags)

    def _limited(self, seg: Segment, frags: list[tuple[int, str]]) -> Iterator[Segment]:
        if not self.o.limited or self._fits(seg, frags):
            yield seg
            return
        meta = seg.meta
        if self.page_only:
            last = frags[-1][0]
            fit = next(k for k, (i, _) in enumerate(frags) if last - i <= self.o.max_pages)
            tail = [i for i, t in frags[fit:] if t.strip(SPACES)] or [None]
            for text, first, end in [*((t, i, i) for i, t in frags[:fit]), (self.o.glue.join([t for _, t in frags[fit:]]), tail[0], tail[-1])]:
                if content := text.strip(SPACES):
                    yield Segment(content, first, None if end == first else end, meta, seg.ord, seg.word, 0)
                    meta = {}
            return
        ids = [i for i, _ in frags]
        for p in self.breaker.pieces(ids, [t for _, t in frags]):
            first, last = ids[p.first], ids[p.last]
            yield Segment(p.content, first, None if last == first else last, meta, seg.ord, seg.word, p.breakpoint, p.word, p.reason)
            meta = {}
