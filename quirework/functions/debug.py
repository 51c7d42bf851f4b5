"""Why a segment begins where it does: provenance as readable text."""

from __future__ import annotations

from typing import Any


def explain(provenance: dict[str, Any] | None, concise: bool = False) -> str:
    """One line on the rule, breakpoint or length limit that made a segment; '-' without provenance."""
    if not provenance:
        return "-"
    parts = []
    if rule := provenance.get("rule"):
        words = f" word {rule['word']}" if rule.get("word") is not None else ""
        parts.append(f"rule {rule['index']}" if concise else f"rule {rule['index']} ({rule['type']}){words}")
    if broke := provenance.get("breakpoint"):
        parts.append(f"breakpoint {broke['index']}" if concise else f"breakpoint {broke['index']} ({broke['pattern'] or 'page boundary'})")
    if limit := provenance.get("length"):
        parts.append("length" if concise else f"length limit {limit['max']} ({limit['reason']})")
    return ", ".join(parts) or "-"
