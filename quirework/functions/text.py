"""Column functions over page text; all run in the JVM inside code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPACE

ZERO_WIDTH = r"\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF"
MARKS = r"\u0610-\u061A\u0640\u064B-\u065F\u0670\u06D6-\u06ED"
DIACRITICS = r"[\u064B-\u065F\u0670\u06D6-\u06ED]"
#: The characters of ``SPACE`` themselves, for ``str.strip``.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_line_endings(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def trim_all(c: Column | str) -> Column:
    """Trim every Unicode space and U+FEFF, not only blanks."""
    return F.regexp_replace(_col(c), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def rtrim_all(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"[{SPACE}]+\z", "")


def is_blank(c: Column | str) -> Column:
    return ~_col(c).rlike(rf"[^{SPACE}]")


def collapse_whitespace(c: Column | str) -> Column:
    return trim_all(F.regexp_replace(_col(c), rf"[{SPACE}]+", " "))


def remove_zero_width(c: Column | str, mode: str = "strip") -> Column:
    """Drop invisible format characters; ``space`` turns a run of them into one blank, but not at the
    text's start or after white space."""
    if mode == "strip":
        return F.regexp_replace(_col(c), f"[{ZERO_WIDTH}]", "")
    if mode != "space":
        raise ValueError(f"unknown mode {mode!r}")
    visible = SPACE.replace(r"\uFEFF", "")
    after_space = F.regexp_replace(_col(c), rf"(\A|[{visible}])[{ZERO_WIDTH}]+", "$1")
    return F.regexp_replace(after_space, f"[{ZERO_WIDTH}]+", " ")


def condense_ellipsis(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\.{2,}", "\u2026")


def fix_trailing_waw(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), " \u0648 ", " \u0648")


def strip_diacritics(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), DIACRITICS, "")


#: Bytes of text that a worker has as Python's strings at once, whatever a batch holds.
PART_BYTES = 1 << 22


def composed(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFC of texts, a part of each array at a time."""
    for texts in arrays:
        step = max(1, min(len(texts), len(texts) * PART_BYTES // max(1, texts.nbytes)))
        for at in range(0, len(texts), step):
            yield pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.slice(at, step).to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Canonical composition: Spark has no built-in for it."""

    def compose(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return composed(parts)

    compose.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(compose, "string")(c)


def normalize_for_comparison(c: Column | str) -> Column:
    """NFC, no joiners, single blanks, no marks, letter variants folded; Python only where text isn't ASCII."""
    c = _col(c)
    other = c.rlike(r"[^\x00-\u02FF\u0600-\u064A\u066E-\u06D3]")
    whole = F.when(other, nfc(F.when(other, c))).otherwise(c)  # Python is asked for every row, so the others' texts are left out
    light = collapse_whitespace(F.regexp_replace(whole, r"[\u200C\u200D]", ""))
    return F.translate(F.regexp_replace(light, f"[{MARKS}]", ""), "\u0622\u0623\u0625\u0629\u0649", "\u0627\u0627\u0627\u0647\u064a")


@lru_cache(maxsize=1)
def _one():
    import regex

    return regex.compile(rf"[{SPACE}]+").sub, regex.compile(f"[{MARKS}]").sub, str.maketrans("\u0622\u0623\u0625\u0629\u0649", "\u0627\u0627\u0627\u0647\u064a")


def normalize_one(text: str) -> str:
    """``normalize_for_comparison`` of one string, for configuration and workers."""
    blanks, marks, folded = _one()
    light = blanks(" ", unicodedata.normalize("NFC", text).replace("\u200c", "").replace("\u200d", "")).strip(" ")
    return marks("", light).translate(folded)


def preview(c: Column | str, limit: int = 140) -> Column:
    flat = collapse_whitespace(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("...")))


def strip_html(c: Column | str) -> Column:
    """Text of a page: scripts, styles and comments go, blocks become lines, entities are resolved."""
    out = F.regexp_replace(_col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return trim_all(F.regexp_replace(out, r"[ \t]*\n\s*", "\n"))


TRANSFORMS = {"removeZeroWidth": remove_zero_width, "condenseEllipsis": lambda c, mode=None: condense_ellipsis(c), "fixTrailingWaw": lambda c, mode=None: fix_trailing_waw(c)}


def preprocess(content: Column | str, page_id: Column | str, transforms: list) -> Column:
    """Fold the transforms over the text, each only where the page id is within its min and max."""
    out = _col(content)
    for t in transforms:
        t = {"type": t} if isinstance(t, str) else t
        if t["type"] not in TRANSFORMS:
            raise ValueError(f"unknown preprocess transform {t['type']!r}")
        new = remove_zero_width(out, t.get("mode", "strip")) if t["type"] == "removeZeroWidth" else TRANSFORMS[t["type"]](out)
        low, high = t.get("min"), t.get("max")
        if low is None and high is None:
            out = new
            continue
        ok = F.lit(True)
        if low is not None:
            ok = ok & (_col(page_id) >= low)
        if high is not None:
            ok = ok & (_col(page_id) <= high)
        out = F.when(ok, new).otherwise(out)
    return out
