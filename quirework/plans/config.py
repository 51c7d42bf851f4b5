"""Segmentation options as frozen driver-side objects, read from JSON-like dicts."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions import dialect
from ..functions.templates import escape_brackets, expand, fuzzy_by_default

PATTERN_KEYS = ("lineStartsWith", "lineStartsAfter", "lineEndsWith", "template", "regex", "dictionaryEntry")
INVISIBLE = r"[\u200E\u200F\u061C\u200B-\u200D\uFEFF]*"
#: The key of provenance in a segment's metadata.
PROVENANCE = "_prov"


def page_ranges(exclude: list | None) -> list[tuple[int, int]]:
    """Single ids and [from, to] pairs as inclusive ranges."""
    return [(x, x) if isinstance(x, int) else (int(x[0]), int(x[1])) for x in exclude or []]


@dataclass(frozen=True)
class Rule:
    """One split rule: exactly one pattern, where to cut, which pages and which matches count."""

    kind: str
    patterns: tuple[str, ...] = ()
    entry: Any = None
    split: str = "at"
    occurrence: str = "all"
    fuzzy: bool | None = None
    min: int | None = None
    max: int | None = None
    exclude: tuple[tuple[int, int], ...] = ()
    page_start_guard: str | None = None
    page_start_stoplist: tuple[str, ...] = ()
    same_page_stoplist: tuple[str, ...] = ()
    meta: dict[str, str] = field(default_factory=dict, hash=False)

    @staticmethod
    def of(raw: dict[str, Any]) -> Rule:
        kinds = [k for k in PATTERN_KEYS if raw.get(k)]
        if len(kinds) != 1:
            raise ValueError(f"a rule needs exactly one of {', '.join(PATTERN_KEYS)}, not {kinds or 'none'}")
        kind, value = kinds[0], raw[kinds[0]]
        if raw.get("split", "at") not in ("at", "after"):
            raise ValueError(f"split must be 'at' or 'after', not {raw['split']!r}")
        if raw.get("occurrence", "all") not in ("all", "first", "last"):
            raise ValueError(f"occurrence must be 'all', 'first' or 'last', not {raw['occurrence']!r}")
        return Rule(
            kind, tuple([value] if isinstance(value, str) else value) if kind != "dictionaryEntry" else (), value if kind == "dictionaryEntry" else None,
            raw.get("split", "at"), raw.get("occurrence", "all"), raw.get("fuzzy"), raw.get("min"), raw.get("max"), tuple(page_ranges(raw.get("exclude"))),
            raw.get("pageStartGuard"), tuple(raw.get("pageStartPrevWordStoplist") or ()), tuple(raw.get("samePagePrevWordStoplist") or ()),
            {k: v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in (raw.get("meta") or {}).items()},
        )

    @property
    def line_anchored(self) -> bool:
        return self.kind in ("lineStartsWith", "lineStartsAfter", "lineEndsWith")

    def source(self) -> str:
        """The rule's whole pattern; alternatives are named ``_r0, _r1, ...`` and the rest of the line ``_content``."""
        if self.kind == "regex":
            return self.patterns[0]
        if self.kind == "template":
            return expand(escape_brackets(self.patterns[0])).pattern
        if self.kind == "dictionaryEntry":
            from ..operators.lexicon_rule import entry_source

            return entry_source(self.entry)
        fuzzy = fuzzy_by_default(self.patterns) if self.fuzzy is None else self.fuzzy
        parts = "|".join(f"(?<_r{i}>{expand(escape_brackets(p), fuzzy).pattern})" for i, p in enumerate(self.patterns))
        if self.kind == "lineEndsWith":
            return f"(?:{parts})$"
        return f"^{INVISIBLE}(?:{parts})" + ("(?<_content>.*)" if self.kind == "lineStartsAfter" else "")

    def admits(self, page_id: int) -> bool:
        """min and max only; exclusions don't matter for text before the first cut."""
        return (self.min is None or page_id >= self.min) and (self.max is None or page_id <= self.max)

    def allows(self, page_id: int) -> bool:
        return self.admits(page_id) and not any(a <= page_id <= b for a, b in self.exclude)

    @property
    def standalone(self) -> bool:
        """Raw patterns with groups or back references are scanned on their own and may overlap others."""
        if self.kind != "regex":
            return False
        source = self.patterns[0]
        return dialect.has_positional_group(source) or bool(dialect.group_names(source)) or dialect.has_backreference(source)


@dataclass(frozen=True)
class Breakpoint:
    """Where an oversized segment may be cut again; an empty pattern is the page boundary."""

    pattern: str = ""
    regex: str | None = None
    words: tuple[str, ...] = ()
    split: str = "after"
    skip_when: str | None = None
    min: int | None = None
    max: int | None = None
    exclude: tuple[tuple[int, int], ...] = ()

    @staticmethod
    def of(raw: str | dict[str, Any]) -> Breakpoint | None:
        if isinstance(raw, str):
            return Breakpoint(raw)
        words = raw.get("words")
        if words is not None and (raw.get("pattern") is not None or raw.get("regex") is not None):
            raise ValueError("a breakpoint has either words or a pattern")
        if words is not None:
            words = [w.lstrip() for w in words if w.strip()]
            if not words:
                return None
        split = raw.get("split")
        if split not in ("at", "after"):
            split = "at" if words else "after"
        return Breakpoint(raw.get("pattern") or "", raw.get("regex"), tuple(words or ()), split, raw.get("skipWhen"), raw.get("min"), raw.get("max"), tuple(page_ranges(raw.get("exclude"))))

    def source(self) -> str | None:
        """None for the page boundary."""
        if self.words:
            from ..functions.templates import SIMPLE, escape_regex

            def literal(word: str) -> str:
                out, at = "", 0
                for m in SIMPLE.finditer(word):
                    out, at = out + escape_regex(word[at : m.start()]) + m[0], m.end()
                return out + escape_regex(word[at:])

            indexed: dict[str, int] = {}
            for i, w in enumerate(self.words):
                indexed.setdefault(expand(literal(w)).pattern, i)
            parts = sorted(indexed.items(), key=lambda x: -len(x[0]))
            return r"\s+(?:" + "|".join(f"(?<_w{i}>{p})" for p, i in parts) + ")"
        if self.regex is not None:
            return expand(self.regex).pattern
        return expand(escape_brackets(self.pattern)).pattern if self.pattern else None

    def allows(self, page_id: int) -> bool:
        return (self.min is None or page_id >= self.min) and (self.max is None or page_id <= self.max)

    def excludes(self, page_id: int) -> bool:
        return any(a <= page_id <= b for a, b in self.exclude)


@dataclass(frozen=True)
class Options:
    rules: tuple[Rule, ...] = ()
    dictionary: Any = None
    preprocess: tuple = ()
    max_pages: int | None = None
    max_content_length: int | None = None
    breakpoints: tuple[Breakpoint, ...] = ()
    prefer: str = "longer"
    joiner: str = "space"
    debug: bool = False

    @staticmethod
    def of(raw: dict[str, Any] | Options) -> Options:
        if isinstance(raw, Options):
            return raw
        limit = raw.get("maxContentLength")
        if limit is not None and limit < 50:
            raise ValueError("maxContentLength must be 50 or more")
        joiner = raw.get("pageJoiner", "space")
        if joiner not in ("space", "newline"):
            raise ValueError(f"pageJoiner must be 'space' or 'newline', not {joiner!r}")
        breaks = [Breakpoint.of(b) for b in raw.get("breakpoints") or ()]
        rules = tuple(Rule.of(r) for r in raw.get("rules") or ())
        for source in [r.source() for r in rules] + [b.source() for b in breaks if b]:
            if source is not None:
                dialect.compile_python(source)  # wrong patterns fail here and not in a worker
        return Options(
            rules, raw.get("dictionary"), tuple(raw.get("preprocess") or ()), raw.get("maxPages"), limit,
            tuple(b for b in breaks if b), raw.get("prefer", "longer"), joiner, bool(raw.get("debug")),
        )

    @property
    def limited(self) -> bool:
        return self.max_pages is not None or self.max_content_length is not None

    @property
    def glue(self) -> str:
        return "\n" if self.joiner == "newline" else " "
