"""Segmentation advice: what lines and sequences recur, which rules that suggests, and how well they cut.

The tables that grow with the books are aggregated by Spark; only the few top patterns reach the driver,
where rules are drafted from them.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import fuzzy_by_default
from ..operators import check, detect, mine
from .config import Options
from .tooling import format_report, optimize_rules, validate_rules

KINDS = {"bab": "chapter", "basmalah": "chapter", "fasl": "section", "kitab": "book"}
NUMBERS = ("numbered", "raqms", "raqm", "nums", "num")
BREAKPOINTS = ["{{tarqim}}\\s*", ""]
RANK = {"high": 3, "medium": 2, "low": 1}
CLEANERS = (("zero_width", "removeZeroWidth", "invisible marks hide line starts and tokens"), ("ellipses", "condenseEllipsis", "runs of full stops make false breakpoints"), ("spaced_waw", "fixTrailingWaw", "a waw apart from its word is a scanning artefact"))


def _tokens(pattern: str) -> list[str]:
    return re.findall(r"\{\{(\w+)(?::[^}]+)?\}\}", pattern)


def _structural(tokens: list[str]) -> str | None:
    return next((KINDS[t] for t in tokens if t in KINDS), None)


def _numbered(tokens: list[str]) -> bool:
    return any(t in NUMBERS for t in tokens)


def named_captures(pattern: str) -> str:
    """The first number token and every source code get capture names."""
    if "{{numbered}}" in pattern:
        pattern = pattern.replace("{{numbered}}", "{{raqms:num}} {{dash}} ", 1)
    else:
        token = next((t for t in NUMBERS[1:] if f"{{{{{t}}}}}" in pattern), None)
        if token:
            pattern = pattern.replace(f"{{{{{token}}}}}", f"{{{{{token}:num}}}}", 1)
    return pattern.replace("{{rumuz}}", "{{rumuz:source}}", 1)


def _before_words(pattern: str) -> str:
    """A numbered opening up to the first token that belongs to the text it numbers."""
    ends = [m.start() for m in re.finditer(r"\{\{(?:naql|bab|basmalah|fasl|kitab)(?::[^}]*)?\}\}", pattern)]
    return pattern[: min(ends)].rstrip() if ends else pattern


def draft_rule(pattern: str, line_start: bool) -> dict[str, Any]:
    tokens = _tokens(pattern)
    kind = _structural(tokens) or ("entry" if "naql" in tokens or _numbered(tokens) else None)
    rule: dict[str, Any] = {"fuzzy": fuzzy_by_default(pattern), "split": "at"} | ({"meta": {"type": kind}} if kind else {})
    if not line_start:
        return rule | {"template": named_captures(pattern)}
    if not _structural(tokens) and _numbered(tokens):
        return rule | {"lineStartsAfter": [named_captures(_before_words(pattern))]}
    return rule | {"lineStartsWith": [pattern]}


def confidence(tokens: list[str]) -> str:
    return "high" if _structural(tokens) or _numbered(tokens) or "naql" in tokens else "medium" if tokens else "low"


def reason(tokens: list[str], line_start: bool) -> str:
    if kind := _structural(tokens):
        return f"a recurring heading word marks each {kind}"
    if _numbered(tokens):
        return "recurring numbers look like the starts of entries"
    if "naql" in tokens:
        return "a phrase of transmission opens lines again and again" if line_start else "a phrase of transmission recurs within prose"
    return "many lines open like this" if line_start else "this sequence recurs within prose"


def _suggestion(row: Any, line_start: bool) -> dict[str, Any]:
    tokens = _tokens(row["pattern"])
    example = row["examples"][0] if row["examples"] else None
    return {
        "source": "line-start" if line_start else "repeating-sequence", "pattern": row["pattern"], "count": row["count"], "confidence": confidence(tokens), "reason": reason(tokens, line_start),
        "example": {"page_id": example["page_id"] if example else -1, "text": (example["line" if line_start else "text"]) if example else ""}, "rule": draft_rule(row["pattern"], line_start),
    }


def assess(top_line: int, top_sequence: int, lines: int, pages: int) -> str:
    dense = lines > pages
    if dense and top_line >= max(2, top_sequence):
        return "structured"
    return "continuous" if not dense and top_sequence > top_line else "mixed"


def _evaluated(pages: DataFrame, options: dict, samples: int) -> dict[str, Any] | None:
    if not options.get("rules"):
        return None
    try:
        o = Options.of(options)
        told = check.measured(pages, o).drop("errors", "warnings").first().asDict()
        return told | {"samples": [r.asDict() for r in check.first_segments(pages, o, samples)]}
    except ValueError:
        return None


def _as_templates(options: dict) -> dict | None:
    """The same numbered openings as free templates, which keep the marker and match in more places."""
    rules = options.get("rules") or []
    if not rules or any(len(r.get("lineStartsAfter") or ()) != 1 for r in rules):
        return None
    drafts = [{k: r[k] for k in ("meta", "split") if k in r} | {"template": "^" + r["lineStartsAfter"][0]} for r in rules]
    return {k: v for k, v in options.items() if k != "rules"} | {"rules": drafts, "pageJoiner": "newline"}


def suggest_options(
    pages: DataFrame, max_rules: int = 4, min_line_start_count: int | None = None, min_repeating_count: int | None = None, sample_segments: int = 5, top_line_starts: int = 12, top_repeating_sequences: int = 8,
) -> dict[str, Any]:
    """A report: assessment, preprocess, suggestions, recommended options with their evaluation, breakpoints.

    Several aggregates read the pages, each from their source: nothing of them is kept on disk.
    """
    lines = F.sum(F.size(F.split("content", "\n", -1)))
    size = detect.page_detections(pages, F.count(F.lit(1)).alias("pages"), F.coalesce(lines, F.lit(0)).alias("lines"), F.coalesce(F.avg(F.length("content")), F.lit(0.0)).alias("mean")).first().asDict()
    found = {k: size[k] for k, _, _ in CLEANERS}
    least = 3 if size["pages"] >= 25 else 2
    cleaners = [{"transform": name, "count": found[key], "reason": why} for key, name, why in CLEANERS if found[key]]
    starts = mine.common_line_starts(pages, min_line_start_count or least, top_line_starts, sort_by="count").collect()  # at most top_line_starts rows
    sequences = mine.repeating_sequences(pages, 1, 3, min_repeating_count or least, top_repeating_sequences, max_examples=1, max_unique_patterns=None).collect()  # at most top_repeating_sequences rows
    starts.sort(key=lambda r: -r["count"])
    sequences.sort(key=lambda r: -r["count"])
    mode = assess(starts[0]["count"] if starts else 0, sequences[0]["count"] if sequences else 0, size["lines"], size["pages"])
    weight = {"structured": {"line-start": 3, "repeating-sequence": 1}, "continuous": {"line-start": 1, "repeating-sequence": 3}, "mixed": {"line-start": 3, "repeating-sequence": 2}}[mode]
    distinct: dict[str, dict] = {}
    for s in [*(_suggestion(r, True) for r in starts), *(_suggestion(r, False) for r in sequences)]:
        distinct.setdefault(json.dumps(s["rule"], sort_keys=True), s)
    suggestions = sorted(distinct.values(), key=lambda s: (-weight[s["source"]], -RANK[s["confidence"]], -s["count"], s["pattern"]))
    wanted = "repeating-sequence" if mode == "continuous" else "line-start"
    chosen = ([s for s in suggestions if s["source"] == wanted] or suggestions)[:max_rules]
    rules, merged = optimize_rules([s["rule"] for s in chosen])
    options: dict[str, Any] = ({"pageJoiner": "newline"} if wanted == "line-start" else {}) | {"rules": rules} | ({"preprocess": [c["transform"] for c in cleaners]} if cleaners else {})
    result = _evaluated(pages, options, sample_segments)
    if (other := _as_templates(options)) and (second := _evaluated(pages, other, sample_segments)):
        if result is None or second["segment_count"] > result["segment_count"] and second["issues"] <= result["issues"]:
            options, result = other, second
    large = result is not None and (result["multi_page"] > 0 or result["max_length"] > 4000) or size["mean"] > 2500
    validation = validate_rules(options["rules"])
    return {
        "assessment": {"mode": mode}, "preprocess": {"detections": found, "suggestions": cleaners}, "line_starts": [r.asDict(True) for r in starts], "repeating_sequences": [r.asDict(True) for r in sequences],
        "rule_suggestions": suggestions, "optimization": {"rules": len(chosen), "optimized": len(rules), "merged": merged}, "recommended_options": options, "evaluation": result,
        "breakpoints": [{"breakpoints": BREAKPOINTS, "maxPages": 1, "prefer": "longer"}] if large else [], "rule_validation": [v for v in validation if v], "rule_errors": format_report(validation),
    }


def inspect_book(pages: DataFrame, **limits) -> dict[str, Any]:
    """What a book holds, without advice."""
    report = suggest_options(pages, **limits)
    return {k: report[k] for k in ("assessment", "preprocess", "line_starts", "repeating_sequences")}


def report_markdown(report: dict[str, Any]) -> str:
    lines = [f"# Segmentation advice: {report['assessment']['mode']}", "", "## Suggested rules", ""]
    lines += [f"- `{s['pattern']}` ({s['source']}, {s['confidence']}, {s['count']} times): {s['reason']}" for s in report["rule_suggestions"]]
    lines += ["", "## Recommended options", "", "```json", json.dumps(report["recommended_options"], ensure_ascii=False, indent=2), "```"]
    if report["evaluation"]:
        lines += ["", "## Evaluation", "", *[f"- {k}: {v}" for k, v in report["evaluation"].items() if k != "samples"]]
    return "\n".join([*lines, *[f"- warning: {e}" for e in report["rule_errors"]]]) + "\n"
