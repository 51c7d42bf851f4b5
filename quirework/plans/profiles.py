"""Lexicon profiles of our own wording, from plain to layered books."""

from __future__ import annotations

import json
from typing import Any

from ..operators.lexicon_words import AND, SO, each

#: Words before a colon that open remarks and not entries: verbs of saying and explaining, particles, pronouns, names of parts.
SAYING = "قال قالت قالوا يقول تقول نقول يقال قيل قلت قولهم قوله قولك قرأ قرئ أنشد روي روى حكى حكي زعم ذكر سئل أخبر حدث سمعت معناه معناها المعنى تفسيره تقديره".split()
PARTICLES = "أي يعني أراد يريد منه منها فيه فيها به بها له لها عنه عليه هو هي هذا هذه ذلك تلك إذا إن أن ما لا أما كذا كذلك مثل مثله نحو نحوه غيره بعضهم غيرهم".split()
PARTS = "الحديث حديث رواية آية شعر بيت مثال فائدة تنبيه مسألة جمعه جمعها واحده واحدها مصدره أصله أصلها جمع ضده لغة اللغة النسبة".split()
STOP_WORDS = tuple(dict.fromkeys([*each(SO, SAYING), *each(SO, PARTICLES), *each(AND, PARTS)]))
GUARDS: list[dict[str, Any]] = [{"use": "stopLemma", "words": list(STOP_WORDS)}, {"use": "intro"}, {"use": "authorityIntro"}, {"use": "pageContinuation"}]
ENTRY = {"use": "lineEntry", "wrappers": "none", "allowWhitespaceBeforeColon": True}
HEADINGS = [{"use": "heading", "classes": ["chapter"], "emit": "chapter"}, {"use": "heading", "classes": ["entry"], "emit": "entry"}]


def _profile(*zones: dict[str, Any]) -> dict[str, Any]:
    return {"version": 2, "zones": list(zones)}


PROFILES: dict[str, dict[str, Any]] = {
    "plain": _profile({"name": "all", "families": [*HEADINGS, ENTRY], "blockers": GUARDS}),
    "waw": _profile({"name": "all", "families": [*HEADINGS, ENTRY, {"use": "inlineSubentry", "prefixes": ["و"]}], "blockers": [*GUARDS, {"use": "previousWord", "scope": "any", "words": ["عن", "ابن", "أبي"]}]}),
    "codes": _profile({"name": "all", "families": [*HEADINGS, {"use": "codeLine", "wrappers": "either"}, {"use": "pairedForms", "separator": "comma", "requireStatusTail": True, "emit": "marker"}, ENTRY], "blockers": GUARDS}),
    "front_matter": _profile(
        {"name": "front", "families": [HEADINGS[0]]},
        {"name": "body", "when": {"activateAfter": [{"use": "headingToken", "token": "bab"}, {"use": "headingToken", "token": "kitab"}]}, "families": [*HEADINGS, ENTRY], "blockers": GUARDS},
    ),
}


def book_options(name: str) -> dict[str, Any]:
    """Whole segmentation options around a profile."""
    return {"breakpoints": ["{{tarqim}}"], "dictionary": PROFILES[name], "maxPages": 1, "preprocess": ["removeZeroWidth"]}


def export_options() -> str:
    return json.dumps({name: book_options(name) for name in PROFILES}, ensure_ascii=False, indent=2)
