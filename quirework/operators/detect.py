"""Where tokens occur in a text, and what rule a marked-up text suggests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dialect import SPACE, compile_python
from ..functions.templates import TOKENS
from .layout import parts

FIRST = "basmalah kitab bab fasl naql rumuz numbered raqms raqm tarqim bullet dash harf".split()
ORDER = [*FIRST, *sorted(set(TOKENS) - set(FIRST))]
STRUCTURAL, NUMBERS = ("basmalah", "kitab", "bab", "fasl"), ("raqms", "raqm", "numbered")
FOUND = "array<struct<token:string,match:string,index:int,end_index:int>>"
ARROW = pa.list_(pa.struct([("token", pa.string()), ("match", pa.string()), ("index", pa.int32()), ("end_index", pa.int32())]))
BEFORE_CODE = regex.compile(rf"[{SPACE}(\[{{]|[^؀-ۿ]")
AFTER_CODE = regex.compile(rf"[{SPACE}:：\-–—ـ،؛.?!؟)\]}}]|[^؀-ۿ]")


@lru_cache(maxsize=1)
def _compiled():
    return [(t, compile_python(TOKENS[t]).regex) for t in ORDER]


def detect(text: str | None) -> list[dict]:
    """Tokens by priority; what an earlier one covers later ones can't have.  In order of position."""
    if not text:
        return []
    out: list[dict] = []
    taken = bytearray(len(text))
    for token, pattern in _compiled():
        for m in pattern.finditer(text):
            a, b = m.span()
            if a == b or any(taken[a:b]):
                continue
            if token == "rumuz" and not ((a == 0 or BEFORE_CODE.match(text[a - 1])) and (b == len(text) or AFTER_CODE.match(text[b]))):
                continue
            taken[a:b] = b"\1" * (b - a)
            out.append({"token": token, "match": m[0], "index": a, "end_index": b})
    return sorted(out, key=lambda d: d["index"])


def template_of(text: str, found: list[dict]) -> str:
    for d in sorted(found, key=lambda d: -d["index"]):
        text = f"{text[: d['index']]}{{{{{d['token']}}}}}{text[d['end_index'] :]}"
    return text


def suggest_config(found: list[dict]) -> dict:
    tokens = [d["token"] for d in found]
    if any(t in STRUCTURAL for t in tokens):
        return {"patternType": "lineStartsWith", "fuzzy": True, "metaType": next((t for t in tokens if t in STRUCTURAL[1:]), "chapter")}
    if any(t in NUMBERS for t in tokens):
        return {"patternType": "lineStartsAfter", "fuzzy": False, "metaType": "hadith"}
    return {"patternType": "lineStartsAfter", "fuzzy": False}


def analyze_text_for_rule(text: str) -> dict | None:
    found = detect(text)
    return {"template": template_of(text, found), "detected": found} | suggest_config(found) if found else None


def detect_tokens(pages: DataFrame, content: str = "content", name: str = "tokens") -> DataFrame:
    """``pages`` with the tokens of each text as an array; narrow, whole texts."""
    at = pages.columns.index(content)
    names = [*pages.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([detect(t.as_py()) for t in part.column(at)], ARROW)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{fields}, `{name}` {FOUND}")


def token_counts(pages: DataFrame, content: str = "content") -> DataFrame:
    """token, count over all texts; a worker sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(d["token"] for batch in batches for t in batch.column(0) for d in detect(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "count"])

    return pages.select(content).mapInArrow(run, "token string, count long").groupBy("token").agg(F.sum("count").alias("count"))


def suggest_rules(lines: DataFrame, content: str = "line") -> DataFrame:
    """Each line with its template and the pattern type, fuzziness and kind that its tokens suggest."""
    found = detect_tokens(lines, content)
    names = F.col("tokens.token")
    structural, numbers = F.exists(names, lambda t: t.isin(*STRUCTURAL)), F.exists(names, lambda t: t.isin(*NUMBERS))
    kind = F.coalesce(F.get(F.filter(names, lambda t: t.isin(*STRUCTURAL[1:])), 0), F.lit("chapter"))
    body = F.aggregate(F.reverse("tokens"), F.col(content), lambda acc, d: F.concat(F.substring(acc, F.lit(1), d["index"]), F.lit("{{"), d["token"], F.lit("}}"), F.substring(acc, d["end_index"] + 1, F.length(acc))))
    return found.where(F.size("tokens") > 0).select(
        *lines.columns, body.alias("template"), F.when(structural, "lineStartsWith").otherwise("lineStartsAfter").alias("pattern_type"), structural.alias("fuzzy"),
        F.when(structural, kind).when(numbers, "hadith").alias("meta_type"),
    )


def page_detections(pages: DataFrame, *more: Column) -> DataFrame:
    """zero_width, ellipses, spaced_waw: how often each cleanable thing occurs, and ``more``; one aggregate in the JVM."""
    c = F.col("content")
    return pages.agg(
        F.coalesce(F.sum(F.regexp_count(c, F.lit(f"[{X.ZERO_WIDTH}\\u061C]"))), F.lit(0)).alias("zero_width"),
        F.coalesce(F.sum(F.regexp_count(c, F.lit(r"\.{3,}"))), F.lit(0)).alias("ellipses"),
        F.coalesce(F.sum(F.regexp_count(c, F.lit(rf"[{SPACE}]و[{SPACE}]+(?=[؀-ۿ])"))), F.lit(0)).alias("spaced_waw"),
        *more,
    )
