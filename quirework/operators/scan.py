"""Scanning a whole book for split points, for rules that lines can't decide one by one.

Runs in a worker, one book at a time, and returns points only; texts never come back from Python.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from ..functions.dialect import SPACE, compile_python
from ..functions.templates import WORD, escape_brackets, expand, fuzzy_by_default
from ..functions.text import normalize_one
from ..plans.config import Rule

SENTENCE_END = ".!?؟؛۔…"


@dataclass
class Point:
    page: int
    local: int
    rule: int
    offset: int = 0
    captured: str | None = None
    meta: dict[str, str] | None = None
    word: int | None = None


class Book:
    """Page texts joined by line breaks, with offsets back to pages."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.texts = ids, texts
        self.starts, at = [], 0
        for t in texts:
            self.starts.append(at)
            at += len(t) + 1
        self.text = "\n".join(texts)

    def page_of(self, at: int) -> int:
        return max(0, bisect_right(self.starts, at) - 1)


def _independent(rule: Rule) -> bool:
    """Scanned on its own, so that it may mark a place that another rule has taken."""
    if rule.standalone:
        return True
    fuzzy = fuzzy_by_default(rule.patterns) if rule.fuzzy is None else rule.fuzzy
    return bool(fuzzy) and rule.kind in ("lineStartsWith", "lineStartsAfter") and all(p.startswith("{{") and p.endswith("}}") and p.count("{{") == 1 and ":" not in p for p in rule.patterns)


class Guards:
    """Whether a match may count, given the text before it."""

    def __init__(self, rules: tuple[Rule, ...]):
        import regex

        self.word = compile_python(WORD).regex
        self.loose = frozenset("0123456789٠١٢٣٤٥٦٧٨٩\"'«»“”‘’()[]{}<>")
        self.space = regex.compile(f"[{SPACE}]")
        self.before = [compile_python(f"(?:{expand(escape_brackets(r.page_start_guard)).pattern})$").regex if r.page_start_guard else None for r in rules]
        self.page_stop = [{normalize_one(w) for w in r.page_start_stoplist} for r in rules]
        self.same_stop = [{normalize_one(w) for w in r.same_page_stoplist} for r in rules]

    def wrapped(self, text: str, more: str = "") -> int:
        """Where ``text`` ends without the spaces, digits, quotes, brackets and ``more`` that may close a page."""
        end = len(text)
        while end and (text[end - 1] in self.loose or text[end - 1] in more or self.space.match(text[end - 1])):
            end -= 1
        return end

    def last_word(self, text: str) -> str | None:
        """The last word, however far back: windows that grow to the left until one holds a whole word."""
        end, width = self.wrapped(text, ".,!?؟؛،:"), 256
        while True:
            start, last = max(0, end - width), None
            for last in self.word.finditer(text, start, end):
                pass
            if last is not None and (last.start() > start or not start):
                return normalize_one(last[0])
            if not start:
                return None
            width *= 4

    def passes(self, k: int, book: Book, page: int, start: int) -> bool:
        local = start - book.starts[page]
        if local == 0 and page > 0:
            before = book.texts[page - 1].rstrip()
            if self.before[k] is not None and not (before and self.before[k].search(before[-1])):
                return False
            if self.page_stop[k]:
                end = self.wrapped(before)
                if not (end and before[end - 1] in SENTENCE_END) and self.last_word(before) in self.page_stop[k]:
                    return False
            return True
        return not (self.same_stop[k] and self.last_word(book.texts[page][:local]) in self.same_stop[k])


class Scanner:
    """All rules, compiled: one alternation for those that share the text, one pattern each for others."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.guards = Guards(rules)
        shared = [k for k, r in enumerate(rules) if not _independent(r)]
        self.passes = ([shared] if shared else []) + [[k] for k, r in enumerate(rules) if _independent(r)]
        self.compiled = [compile_python("|".join(f"(?<_rule{k}>{rules[k].source()})" for k in ks) if len(ks) > 1 or not rules[ks[0]].standalone else rules[ks[0]].source()) for ks in self.passes]

    def points(self, book: Book) -> list[Point]:
        found: list[Point] = []
        for ks, pattern in zip(self.passes, self.compiled, strict=True):
            marks = {int(n[5:]): i for i, _, n in pattern.groups if n.startswith("_rule")}
            for m in pattern.regex.finditer(book.text):
                k = next((r for r in ks if r in marks and m.start(marks[r]) >= 0), ks[0])
                point = self._point(m, k, marks.get(k, 0), pattern.groups, book)
                if point is not None:
                    found.append(point)
        return found

    def _point(self, m, k: int, own: int, groups, book: Book) -> Point | None:
        rule = self.rules[k]
        page = book.page_of(m.start())
        if not rule.allows(book.ids[page]) or not self.guards.passes(k, book, page, m.start()):
            return None
        offset, captured, word = 0, None, None
        meta = dict(rule.meta)
        for i, _, name in groups:
            if i <= own or m.start(i) < 0 or name.startswith("_rule"):
                continue
            if name == "_content":
                offset = len(m[0]) - len(m[i])
            elif name.startswith("_r"):
                word = int(name[2:])
            elif name:
                meta[name] = m[i]
            elif rule.kind == "regex":
                captured = m[i]
        at = m.end() if rule.split == "after" else m.start()
        page = book.page_of(at)
        return Point(page, at - book.starts[page], k, offset, captured, meta, word)
