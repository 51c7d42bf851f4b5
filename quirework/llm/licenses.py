"""License scan: Aho-Corasick over identifier tags and notice phrases, shunting-yard for expressions.

One automaton finds, in the lower-case text with white space runs as single blanks, the tag
``SPDX-License-Identifier:`` and the wordings of well-known notices.  What follows a tag is read as an
expression of identifiers, AND, OR, WITH and brackets, put into postfix order by the shunting-yard
algorithm and evaluated against the classes that are acceptable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = "spdx-license-identifier:"
#: identifier -> class
LICENSES = {
    **dict.fromkeys(["MIT", "MIT-0", "Apache-2.0", "Apache-1.1", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-3.0", "Python-2.0", "PSF-2.0", "BSL-1.0", "WTFPL", "PostgreSQL", "Artistic-2.0", "X11"], "permissive"),
    **dict.fromkeys(["MPL-2.0", "EPL-2.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "CDDL-1.0"], "weak copyleft"),
    **dict.fromkeys(["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-SA-4.0", "CC-BY-SA-3.0", "EUPL-1.2"], "copyleft"),
    **dict.fromkeys(["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC-BY-ND-4.0", "CC-BY-NC-3.0", "LicenseRef-all-rights-reserved", "BUSL-1.1", "SSPL-1.0"], "restricted"),
}
OLD_NAMES = {"GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later"}
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0"]
#: An exception opens a copyleft licence up for linking: its class becomes this one.
EXCEPTED = "weak copyleft"
NOTICES = {
    "MIT": ["mit license", "mit licence", "permission is hereby granted, free of charge, to any person obtaining a copy"],
    "Apache-2.0": ["apache license, version 2.0", "apache license 2.0", "apache licence, version 2.0", "apache-2.0 license", "apache.org/licenses/license-2.0"],
    "BSD-3-Clause": ["bsd 3-clause", "3-clause bsd", "new bsd license", "modified bsd license", "neither the name of the copyright holder nor the names of its contributors"],
    "BSD-2-Clause": ["bsd 2-clause", "2-clause bsd", "simplified bsd license", "freebsd license"],
    "ISC": ["isc license"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "MPL-2.0": ["mozilla public license, version 2.0", "mozilla public license 2.0", "mozilla public license, v. 2.0"],
    "EPL-2.0": ["eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license, version 2.0"],
    "GPL-2.0-only": ["gnu general public license, version 2", "gnu general public license version 2", "gnu gpl version 2", "gnu gpl v2", "gplv2"],
    "GPL-3.0-only": ["gnu general public license, version 3", "gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gplv3"],
    "LGPL-2.1-only": ["gnu lesser general public license, version 2.1", "gnu lesser general public license version 2.1", "lgplv2.1"],
    "LGPL-3.0-only": ["gnu lesser general public license, version 3", "gnu lesser general public license version 3", "lgplv3"],
    "AGPL-3.0-only": ["gnu affero general public license, version 3", "gnu affero general public license version 3", "agplv3"],
    "CC0-1.0": ["cc0 1.0", "cc0-1.0", "creativecommons.org/publicdomain/zero/1.0"],
    "CC-BY-4.0": ["cc by 4.0", "cc-by 4.0", "cc-by-4.0", "creative commons attribution 4.0", "creativecommons.org/licenses/by/4.0"],
    "CC-BY-SA-4.0": ["cc by-sa 4.0", "cc-by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0", "creativecommons.org/licenses/by-sa/4.0"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0", "cc-by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0", "creativecommons.org/licenses/by-nc/4.0"],
    "CC-BY-NC-SA-4.0": ["cc by-nc-sa 4.0", "cc-by-nc-sa 4.0", "cc-by-nc-sa-4.0", "creativecommons.org/licenses/by-nc-sa/4.0"],
    "CC-BY-NC-ND-4.0": ["cc by-nc-nd 4.0", "cc-by-nc-nd 4.0", "cc-by-nc-nd-4.0", "creativecommons.org/licenses/by-nc-nd/4.0"],
    "CC-BY-ND-4.0": ["cc by-nd 4.0", "cc-by-nd 4.0", "cc-by-nd-4.0", "creativecommons.org/licenses/by-nd/4.0"],
    "LicenseRef-all-rights-reserved": ["all rights reserved"],
}
ACCEPTED = ("permissive",)
CANONICAL = {k.lower(): k for k in LICENSES} | {k.lower(): v for k, v in OLD_NAMES.items()}
CANONICAL_EXCEPTION = {k.lower(): k for k in EXCEPTIONS}
RANK = {"or": 1, "and": 2, "with": 3}
LEXEME = re.compile(r" ?([()]|[a-z0-9][a-z0-9.+:-]*)")


def lexemes(text: str, at: int) -> list[str]:
    """The longest well-formed expression of ``text`` from ``at`` on, as lexemes; empty if there is none.

    An unknown word where an identifier should be ends it, unless it is the first: a tag may name a
    licence that isn't listed.
    """
    out: list[str] = []
    depth, wants, good = 0, True, 0
    while found := LEXEME.match(text, at):
        word = found[1]
        if wants:
            if word == "(":
                depth += 1
            else:
                word = word.rstrip(".:") if word.rstrip(".:") else word
                after_with = bool(out) and out[-1] == "with"
                known = word in CANONICAL_EXCEPTION if after_with else word in CANONICAL or word.startswith(("licenseref-", "documentref-"))
                if word in RANK or word == ")" or not known and (out and any(w not in "()" for w in out)):
                    break
                wants = False
        elif word == ")":
            if not depth:
                break
            depth -= 1
        elif word in RANK and not (word == "with" and (out[-1] == ")" or len(out) > 1 and out[-2] == "with")):
            wants = True
        else:
            break
        out.append(word)
        at = found.end()
        if not wants and not depth:
            good = len(out)
    return out[:good]


def postfix(words: list[str]) -> list[str]:
    """Shunting-yard: operands in order, operators after theirs; WITH binds closest, then AND, then OR."""
    out: list[str] = []
    held: list[str] = []
    for w in words:
        if w == "(":
            held.append(w)
        elif w == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif w in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[w]:
                out.append(held.pop())
            held.append(w)
        else:
            out.append(w)
    return out + held[::-1]


def evaluate(words: list[str], accepted: frozenset[str]) -> tuple[str, bool]:
    """The expression in canonical form, fully bracketed where operators mix, and whether it is acceptable."""
    stack: list[tuple[str, bool, str]] = []
    for w in postfix(words):
        if w == "with":
            (exc, _, _), (name, ok, _) = stack.pop(), stack.pop()
            opened = LICENSES.get(name) == "copyleft" and exc in EXCEPTIONS
            stack.append((f"{name} WITH {exc}", EXCEPTED in accepted if opened else ok, "with"))
        elif w in RANK:
            (b, ok_b, op_b), (a, ok_a, op_a) = stack.pop(), stack.pop()
            a, b = (f"({x})" if op in RANK and op not in (w, "with") else x for x, op in ((a, op_a), (b, op_b)))
            stack.append((f"{a} {w.upper()} {b}", ok_a and ok_b if w == "and" else ok_a or ok_b, w))
        else:
            name = CANONICAL.get(w) or CANONICAL_EXCEPTION.get(w) or w
            stack.append((name, LICENSES.get(name) in accepted, ""))
    text, ok, _ = stack[0]
    return text, ok


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    out.add_word(TAG, (len(TAG), None))
    for name, wordings in NOTICES.items():
        for wording in wordings:
            out.add_word(wording, (len(wording), name))
    out.make_automaton()
    return out


def scan(text: str, accepted: frozenset[str]) -> tuple[list[str], list[str], bool | None]:
    """(identifiers, expressions, verdict) of a text: in order of first occurrence, without repeats.

    Of notices that overlap the leftmost counts, of those the longest; a notice must end at a word's end
    and begin at its start.  The verdict is whether all that was found is acceptable, null if nothing was.
    """
    flat = " ".join(text.lower().split())
    hits = []
    for end, (size, name) in automaton().iter(flat):
        start = end + 1 - size
        if name and (flat[start - 1 : start].isalnum() or flat[end + 1 : end + 2].isalnum()):
            continue
        hits.append((start, -size, name))
    names: dict[str, None] = {}
    expressions: dict[str, None] = {}
    verdict, upto = None, 0
    for start, size, name in sorted(hits, key=lambda h: h[:2]):
        if start < upto:
            continue
        upto = start - size
        if name is None:
            if not (words := lexemes(flat, upto)):
                continue
            shown, ok = evaluate(words, accepted)
            expressions[shown] = None
            names |= dict.fromkeys(CANONICAL.get(w, w) for w in words if w not in RANK and w not in "()" and w not in CANONICAL_EXCEPTION)
        else:
            names[name], expressions[name] = None, None
            ok = LICENSES[name] in accepted
        verdict = ok if verdict is None else verdict and ok
    return list(names), list(expressions), verdict


def license_scan(docs: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """doc_id, licenses, expressions, accepted: one row for each row of ``docs``; narrow, whole texts.

    Defined cases: null and empty texts and texts without a licence have empty lists and a null verdict;
    a tag with no readable expression is ignored; an identifier that isn't listed is kept as written (lower
    case) and not acceptable; repeated rows get equal rows; a null doc_id is carried; other columns are
    not read.
    """
    good = frozenset(accepted)
    names = ["doc_id", "licenses", "expressions", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "", good) for t in batch.column(1)]
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string())), pa.array(c, pa.bool_())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licenses array<string>, expressions array<string>, accepted boolean")
