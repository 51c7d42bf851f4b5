"""Rules as configuration: merge and order them, and find what is wrong with them."""

from __future__ import annotations

import json
import re
from typing import Any

from ..functions.dialect import compile_python
from ..functions.templates import TOKENS
from .config import PATTERN_KEYS

LISTS = ("lineStartsWith", "lineStartsAfter", "lineEndsWith")


def _kind(rule: dict[str, Any]) -> str:
    return next((k for k in PATTERN_KEYS if k in rule), "regex")


def specificity(rule: dict[str, Any]) -> int:
    """How particular a rule is: its longest pattern; for headwords, how little the options allow."""
    kind = _kind(rule)
    if kind == "dictionaryEntry":
        o = rule[kind]
        loose = {"allowCommaSeparated": (False, 120), "allowParenthesized": (False, 60), "allowWhitespaceBeforeColon": (False, 20), "midLineSubentries": (True, 160)}
        return 20 * o.get("minLetters", 2) + o.get("maxLetters", 10) + sum(w for k, (d, w) in loose.items() if not o.get(k, d)) + min(len(o.get("stopWords", ())), 25)
    value = rule.get(kind) or ""
    return max(map(len, value), default=0) if kind in LISTS else len(value)


def optimize_rules(rules: list[dict[str, Any]]) -> tuple[list[dict[str, Any]], int]:
    """Rules of one kind and equal options become one with all their patterns, longest first; the most
    specific come first.  Returns them and how many were merged away.
    """
    out: list[dict[str, Any]] = []
    at: dict[str, int] = {}
    merged = 0
    for rule in rules:
        kind = _kind(rule)
        if kind not in LISTS:
            out.append(rule)
            continue
        key = kind + json.dumps({k: v for k, v in rule.items() if k != kind and v is not None}, sort_keys=True, ensure_ascii=False)
        if key in at:
            out[at[key]] = out[at[key]] | {kind: [*out[at[key]][kind], *rule[kind]]}
            merged += 1
        else:
            at[key] = len(out)
            out.append(rule)
    out = [r | {_kind(r): sorted(set(r[_kind(r)]), key=lambda p: (-len(p), p))} if _kind(r) in LISTS else r for r in out]
    return sorted(out, key=lambda r: -specificity(r)), merged


BARE = re.compile(r"(?<!\{\{)(?:" + "|".join(sorted(TOKENS, key=len, reverse=True)) + r")(?::\w+)?(?!\}\})")


def _pattern_issue(pattern: str, seen: set[str]) -> dict[str, Any] | None:
    if not pattern.strip():
        return {"type": "empty_pattern", "message": "an empty pattern matches everywhere"}
    if pattern in seen:
        return {"type": "duplicate", "message": f"the pattern occurs twice: {pattern}", "pattern": pattern}
    seen.add(pattern)
    for m in re.finditer(r"\{\{(\w+)(?::\w+)?\}\}", pattern):
        if m[1] not in TOKENS:
            return {"type": "unknown_token", "message": f"there is no token {{{{{m[1]}}}}}", "token": m[1]}
    rest = re.sub(r"\{\{[^{}]*\}\}", lambda m: " " * len(m[0]), pattern)
    for mark, side in (("{{", "closing"), ("}}", "opening")):
        if mark in rest:
            i = rest.index(mark)
            found = re.match(r"\w+(?::\w+)?", pattern[i + 2 :]) if mark == "{{" else re.search(r"(\w+(?::\w+)?)$", pattern[:i])
            name = found[0] if found else ""
            return {"type": "missing_braces", "message": f"{name or 'a token'} has no {side} braces", "token": name.split(":")[0] or None, "suggestion": f"{{{{{name}}}}}" if name else None}
    for m in BARE.finditer(rest):
        return {"type": "missing_braces", "message": f"{m[0]} is a token's name without braces", "token": m[0].split(":")[0], "suggestion": f"{{{{{m[0]}}}}}"}
    return None


def _entry_issues(o: dict[str, Any]) -> dict[str, dict[str, Any]]:
    wrong: dict[str, str] = {}
    stops = o.get("stopWords")
    if not isinstance(stops, (list, tuple)) or any(not isinstance(w, str) or not w.strip() for w in stops):
        wrong["stopWords"] = "must be a list of words"
    for key in ("allowCommaSeparated", "allowParenthesized", "allowWhitespaceBeforeColon", "midLineSubentries"):
        if not isinstance(o.get(key, True), bool):
            wrong[key] = "must be true or false"
    if not re.fullmatch(r"[A-Za-z_]\w*", str(o.get("captureName", "lemma"))):
        wrong["captureName"] = "must be a name"
    low, high = o.get("minLetters", 2), o.get("maxLetters", 10)
    if not isinstance(low, int) or low < 1:
        wrong["minLetters"] = "must be an integer of 1 or more"
    if not isinstance(high, int) or isinstance(low, int) and high < low:
        wrong["maxLetters"] = f"must be an integer of {low} or more"
    return {k: {"type": "invalid_option", "message": f"{k} {v}"} for k, v in wrong.items()}


def validate_rules(rules: list[dict[str, Any]]) -> list[dict[str, Any] | None]:
    """For each rule None, or what is wrong by pattern key (a list with one slot per pattern, where it has many)."""
    out: list[dict[str, Any] | None] = []
    for rule in rules:
        found: dict[str, Any] = {}
        for key in LISTS:
            if rule.get(key):
                seen: set[str] = set()
                issues = [_pattern_issue(p, seen) for p in rule[key]]
                if any(issues):
                    found[key] = issues
        if "template" in rule and (issue := _pattern_issue(rule["template"], set())):
            found["template"] = issue
        if "regex" in rule:
            try:
                if rule["regex"].strip():
                    compile_python(rule["regex"])
                else:
                    found["regex"] = {"type": "empty_pattern", "message": "an empty pattern matches everywhere"}
            except ValueError as e:
                found["regex"] = {"type": "invalid_regex", "message": str(e), "pattern": rule["regex"]}
        if rule.get("dictionaryEntry") and (issues := _entry_issues(rule["dictionaryEntry"])):
            found["dictionaryEntry"] = issues
        out.append(found or None)
    return out


def format_report(results: list[dict[str, Any] | None]) -> list[str]:
    """One line for each issue: rule number, pattern key, place, type, message."""
    out = []
    for n, found in enumerate(results, 1):
        for key, issues in (found or {}).items():
            each = [(str(i + 1), x) for i, x in enumerate(issues)] if isinstance(issues, list) else list(issues.items()) if key == "dictionaryEntry" else [("", issues)]
            for place, issue in each:
                if issue:
                    hint = f" (try {issue['suggestion']})" if issue.get("suggestion") else ""
                    out.append(f"rule {n}, {key}{' ' + place if place else ''}: {issue['type']}: {issue['message']}{hint}")
    return out
