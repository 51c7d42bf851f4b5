"""One pattern source, two engines: rewrite the common dialect for Java (Spark's) and for Python.

The source's classes are ASCII ``\\d`` and ``\\w``, Unicode ``\\s`` with U+FEFF, a ``\\b`` that knows ASCII words
only and a dot that stops at every line end.  Both engines differ from that and from each other, so each
is spelled out.  Groups are renumbered to unique names, with a table from those to the source's names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WORD = "A-Za-z0-9_"
CLASSES = {"s": SPACE, "d": "0-9", "w": WORD}
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
INSIDE = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
LINE_ENDS = r"\n\r\u2028\u2029"


@dataclass
class Dialect:
    """``source`` for the engine; ``groups``: (index, unique name, source name or '') of each capture."""

    source: str
    groups: list[tuple[int, str, str]] = field(default_factory=list)
    regex: object = None

    def of(self, name: str) -> list[int]:
        return [i for i, _, n in self.groups if n == name]


def _rewrite(source: str, java: bool) -> Dialect:
    out, groups, i, in_class = [], [], 0, False
    while i < len(source):
        c = source[i]
        two = source[i : i + 2]
        if c == "\\" and i + 1 < len(source):
            e = source[i + 1]
            low = e.lower()
            if low in CLASSES and e.isalpha():
                body = CLASSES[low]
                if in_class and e.isupper():
                    raise ValueError(f"\\{e} inside a class is not supported: {source}")
                out.append(body if in_class else f"[{'^' if e.isupper() else ''}{body}]")
            elif e == "b" and not in_class:
                out.append(BOUNDARY)
            elif e == "B" and not in_class:
                out.append(INSIDE)
            elif e == "k" and source[i + 2 : i + 3] == "<":
                end = source.index(">", i)
                name = source[i + 3 : end]
                index = next((n for n, _, own in groups if own == name), None)
                if index is None:
                    raise ValueError(f"unknown group {name}: {source}")
                out.append(f"\\{index}" if java else f"(?:\\{index})")
                i = end + 1
                continue
            elif e == "p" or e == "P":
                found = re.match(r"\{(?:Script|sc)=(\w+)\}", source[i + 2 :])
                if found:
                    out.append(f"\\{e}{{Is{found[1]}}}" if java else f"\\{e}{{Script={found[1]}}}")
                    i += 2 + found.end()
                    continue
                out.append(two)
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[" or java and two in ("&&",):
                out.append("\\")
            out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if source[i : i + 1] == "^":
                out.append("^")
                i += 1
            continue
        if c == "(":
            found = re.match(r"\(\?<([A-Za-z_]\w*)>", source[i:])
            if found or source[i + 1 : i + 2] != "?":
                index = len(groups) + 1
                unique = f"g{index}"
                groups.append((index, unique, found[1] if found else ""))
                out.append(f"(?<{unique}>" if java else f"(?P<{unique}>")
                i += found.end() if found else 1
                continue
        if c == ".":
            out.append(f"[^{LINE_ENDS}]")
            i += 1
            continue
        if java and c == "$":
            out.append(r"(?=\n|\z)")
            i += 1
            continue
        out.append(c)
        i += 1
    if in_class:
        raise ValueError(f"a class is not closed: {source}")
    return Dialect("".join(out), groups)


def for_java(source: str) -> Dialect:
    """For ``rlike``/``regexp_extract``; ``^`` and ``$`` are line ends."""
    out = _rewrite(source, True)
    out.source = "(?md)" + out.source
    return out


def compile_python(source: str) -> Dialect:
    """For scanning in workers; ``^`` and ``$`` are line ends."""
    import regex

    out = _rewrite(source, False)
    try:
        out.regex = regex.compile(out.source, regex.MULTILINE | regex.V0)
    except regex.error as e:
        raise ValueError(f"invalid pattern {source!r}: {e}") from None
    return out


def has_positional_group(source: str) -> bool:
    """A group without a name; escapes and classes don't count."""
    return any(not name for _, _, name in _rewrite(source, False).groups)


def has_backreference(source: str) -> bool:
    return re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)", source) is not None


def group_names(source: str) -> list[str]:
    return [name for _, _, name in _rewrite(source, False).groups if name and not name.startswith(("_r", "_w"))]
