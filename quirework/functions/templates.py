"""Template compiler: readable ``{{token}}`` templates to pattern source, with captures and fuzzy Arabic.

Pattern source is a small common dialect (``(?<name>...)``, ``\\s \\d \\w \\b .``) that ``dialect`` turns into
Java's or Python's.  All of this runs on the driver over configuration, never over data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

MARKS = r"[\u0610-\u061A\u0640\u064B-\u065F\u0670\u06D6-\u06ED]"
BASE_LETTER = "[\u0621-\u063a\u0641-\u064a]"
LETTER = f"{BASE_LETTER}{MARKS}*"
WORD = f"(?:{LETTER})+"
ALEF_ON = "\u0623-\u064a"
NOT_WITHIN_WORD = rf"(?![\u064B-\u0652\u0670{ALEF_ON}])"
SPACED_LETTER = f"[\u0623-\u063a\u0641-\u064a]{MARKS}*"


def _source_codes() -> str:
    pairs = sorted("خت خغ بخ عخ مق مت عس سي سن كن مد قد خد فد دل كد غد صد دت دس تم فق دق".split())
    letters = "".join(sorted("خرزيمنصسدفلتقع"))
    four = r"(?<![\u0660-\u0669])" + "\u0664" + r"(?![\u0660-\u0669])"
    one = "(?:" + "|".join(["تمييز" + NOT_WITHIN_WORD, *pairs, f"[{letters}]{NOT_WITHIN_WORD}", four]) + ")"
    return rf"{one}(?:\s+{one})*"


DASHES = "\\-\u2013\u2014\u0640"
#: Longer words don't hide behind shorter ones here, except where first-match order asks for it.
TRANSMISSION = "أخبرنا أنبأنا حدثنا حدثني سمعت وأخبرنا وحدثنا وحدثني وحدثنيه".split()
TOKENS: dict[str, str] = {
    "bab": "باب",
    "basmalah": "بسم الله|\ufdfd",
    "bullet": "[\u2022*\u00b0]",
    "dash": f"[{DASHES}]",
    "fasl": "مسألة|فصل",
    "harf": f"[{ALEF_ON}]",
    "harfs": rf"{SPACED_LETTER}(?:\s+{SPACED_LETTER})*",
    "hr": f"[{DASHES}_=]{{5,}}",
    "kitab": "كتاب",
    "naql": "|".join(TRANSMISSION),
    "newline": r"\n",
    "num": r"\d",
    "nums": r"\d+",
    "raqm": r"[\u0660-\u0669]",
    "raqms": r"[\u0660-\u0669]+",
    "rumuz": _source_codes(),
    "tarqim": "[.!?\u061f\u061b]",
}
COMPOSITES = {"numbered": "{{raqms}} {{dash}} "}
SIMPLE = re.compile(r"\{\{([A-Za-z0-9_]+)\}\}")
WITH_CAPTURE = re.compile(r"\{\{([A-Za-z0-9_]*):?([A-Za-z0-9_]*)\}\}")
ARABIC = re.compile("[\u0600-\u06ff]")
FUZZY_BY_DEFAULT = ("bab", "basmalah", "fasl", "kitab", "naql")


def expand_composites(template: str) -> str:
    for _ in range(10):
        after = SIMPLE.sub(lambda m: COMPOSITES.get(m[1], m[0]), template)
        if after == template:
            break
        template = after
    return template


TOKENS |= {name: SIMPLE.sub(lambda m: TOKENS.get(m[1], m[0]), expand_composites(body)) for name, body in COMPOSITES.items()}


class Token:
    """``Token.RAQMS`` is ``{{raqms}}``, and so on for every token."""


for _name in TOKENS:
    setattr(Token, _name.upper(), f"{{{{{_name}}}}}")


def available_tokens() -> list[str]:
    return list(TOKENS)


def token_pattern(name: str) -> str | None:
    return TOKENS.get(name)


def contains_tokens(template: str) -> bool:
    return SIMPLE.search(template) is not None


def with_capture(token: str, name: str) -> str:
    """``{{token:name}}``; anything that isn't a token gives the capture-only ``{{:name}}``."""
    found = re.fullmatch(r"\{\{([A-Za-z0-9_]+)\}\}", token)
    return f"{{{{{found[1] if found else ''}:{name}}}}}"


def apply_token_mappings(template: str, mappings: Iterable[tuple[str, str]]) -> str:
    """Give each plain ``{{token}}`` of the mappings its capture name."""
    for token, name in mappings:
        if token and name:
            template = template.replace(f"{{{{{token}}}}}", f"{{{{{token}:{name}}}}}")
    return template


def strip_token_mappings(template: str) -> str:
    return re.sub(r"\{\{([^:}]*):[^}]+\}\}", lambda m: f"{{{{{m[1]}}}}}", template)


def escape_regex(text: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m[0], text)


def escape_brackets(template: str) -> str:
    """Make ``()[]`` literal outside tokens, so that templates can hold them plainly."""
    return re.sub(r"\{\{[^}]*\}\}|[()\[\]]", lambda m: m[0] if m[0].startswith("{{") else "\\" + m[0], template)


SAME = {c: group for group in ("\u0627\u0622\u0623\u0625", "\u0629\u0647", "\u0649\u064a") for c in group}
LOOSE_MARKS = "[\u0640\u064b-\u0652]*"


def diacritic_insensitive(text: str) -> str:
    """A pattern that matches ``text`` with any vowel marks and interchangeable letter forms."""
    light = re.sub(r"\s+", " ", re.sub("[\u200c\u200d]", "", unicodedata.normalize("NFC", text))).strip()
    return "".join((f"[{SAME[c]}]" if c in SAME else escape_regex(c)) + LOOSE_MARKS for c in light)


def _fuzzy_token(pattern: str, fuzzy: Callable[[str], str]) -> str:
    """Only literal alternatives become fuzzy; a class or group stays the class it is."""
    return "|".join(fuzzy(p) if ARABIC.search(p) and not re.search(r"[\[\](){}\\?*+]", p) else p for p in pattern.split("|")) if not re.search(r"[(\[]", pattern) else pattern


@dataclass(frozen=True)
class Expanded:
    pattern: str
    captures: tuple[str, ...]


def expand(template: str, fuzzy: bool = False, prefix: str = "") -> Expanded:
    """Tokens replaced by patterns; captures named ``prefix`` + name, repeats as ``name_2``, ``name_3``."""
    transform = diacritic_insensitive if fuzzy else None
    seen: dict[str, int] = {}
    captures: list[str] = []

    def register(base: str) -> str:
        seen[base] = seen.get(base, 0) + 1
        captures.append(prefix + (base if seen[base] == 1 else f"{base}_{seen[base]}"))
        return captures[-1]

    out, at = [], 0
    for m in WITH_CAPTURE.finditer(template):
        out.append(_plain(template[at : m.start()], transform))
        name, capture = m[1], m[2]
        if not name and capture:
            out.append(f"(?<{register(capture)}>.+)")
        elif name not in TOKENS:
            out.append(m[0])
        else:
            body = _fuzzy_token(TOKENS[name], transform) if transform else TOKENS[name]
            out.append(f"(?<{register(capture)}>{body})" if capture else f"(?:{body})" if "|" in body else body)
        at = m.end()
    out.append(_plain(template[at:], transform))
    return Expanded("".join(out), tuple(captures))


def _plain(text: str, transform: Callable[[str], str] | None) -> str:
    return transform(text) if transform and ARABIC.search(text) else text


def expand_tokens(template: str) -> str:
    return expand(template).pattern


def template_to_regex(template: str):
    """A compiled pattern of the template, or None if it isn't one."""
    from .dialect import compile_python

    try:
        return compile_python(expand_tokens(template)).regex
    except ValueError:
        return None


def fuzzy_by_default(patterns: str | Iterable[str]) -> bool:
    listed = [patterns] if isinstance(patterns, str) else list(patterns)
    names = "|".join(FUZZY_BY_DEFAULT)
    return any(re.search(rf"\{{\{{(?:{names})(?::[A-Za-z0-9_]+)?\}}\}}", p) for p in listed)
