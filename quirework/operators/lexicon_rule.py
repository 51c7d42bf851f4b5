"""Headword rules: a pattern for dictionary entries at line starts and, with a leading waw, within lines."""

from __future__ import annotations

import re
from typing import Any

from ..functions.templates import LETTER, MARKS, diacritic_insensitive
from ..functions.text import normalize_one

DEFAULTS = {"allowCommaSeparated": False, "allowParenthesized": False, "allowWhitespaceBeforeColon": False, "captureName": "lemma", "maxLetters": 10, "midLineSubentries": True, "minLetters": 2, "stopWords": ()}
WAW, AL = f"و{MARKS}*", f"ا{MARKS}*ل{MARKS}*"
COMMA = r"\s*[،,]\s*"


def distinct_words(words) -> list[str]:
    """Words that differ after normalisation, the first spelling of each."""
    seen: dict[str, str] = {}
    for w in words:
        if key := normalize_one(w):
            seen.setdefault(key, w)
    return list(seen.values())


def checked(options: dict[str, Any]) -> dict[str, Any]:
    unknown = set(options) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown headword options: {sorted(unknown)}")
    o = DEFAULTS | options
    if not isinstance(o["minLetters"], int) or o["minLetters"] < 1:
        raise ValueError(f"minLetters must be an integer of 1 or more, not {o['minLetters']!r}")
    if not isinstance(o["maxLetters"], int) or o["maxLetters"] < o["minLetters"]:
        raise ValueError(f"maxLetters must be an integer of minLetters or more, not {o['maxLetters']!r}")
    if not re.fullmatch(r"[A-Za-z_]\w*", o["captureName"]):
        raise ValueError(f"captureName is not a name: {o['captureName']!r}")
    return o


def entry_source(options: dict[str, Any]) -> str:
    """The pattern: boundary, optional brackets, headword (or several with commas), colon; stop words never match."""
    o = checked(options)
    colon = r"\s*:" if o["allowWhitespaceBeforeColon"] else ":"
    word = f"(?:{WAW})?(?:{AL})?{LETTER}(?:{LETTER}){{{o['minLetters'] - 1},{o['maxLetters'] - 1}}}"
    stops = "|".join(diacritic_insensitive(normalize_one(w)) for w in distinct_words(o["stopWords"]))
    if stops:
        end = f"(?:{COMMA}|{colon})" if o["allowCommaSeparated"] else colon
        word = f"(?!(?:{WAW})?(?:{stops}){end}){word}"
    heads = f"{word}(?:{COMMA}{word})*" if o["allowCommaSeparated"] else word
    name = o["captureName"]
    marked = rf"(?:\(\s*(?<{name}>{heads})\s*\)|(?<{name}>{heads})){colon}" if o["allowParenthesized"] else f"(?<{name}>{heads}){colon}"
    start = r"(?<![^\n])[‎‏؜​-‍﻿]*"
    if not o["midLineSubentries"]:
        return start + marked
    opening = r"(?:\(\s*)?" if o["allowParenthesized"] else ""
    return rf"(?:{start}|(?<=\s)(?={opening}{WAW}(?:{AL})?)){marked}"


def dictionary_entry_rule(stop_words, *, meta: dict | None = None, page_start_stoplist=None, same_page_stoplist=None, **options) -> dict[str, Any]:
    """A split rule, as JSON-able options, for entries; stop words are told apart by normalised form."""
    o = checked(options | {"stopWords": tuple(stop_words)})
    rule: dict[str, Any] = {"dictionaryEntry": o | {"stopWords": distinct_words(stop_words)}}
    for key, value in (("meta", meta), ("pageStartPrevWordStoplist", page_start_stoplist), ("samePagePrevWordStoplist", same_page_stoplist)):
        if value is not None:
            rule[key] = value
    return rule
