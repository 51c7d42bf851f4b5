"""Expressions against a truth table by Python's own precedence, and scans against a plain search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quirework.llm.licenses import NOTICES, evaluate, lexemes, license_scan, postfix, scan

GOOD = frozenset(["permissive"])


@pytest.mark.parametrize(
    ("text", "shown", "ok"),
    [
        ("MIT", "MIT", True),
        ("MIT OR GPL-2.0-only", "MIT OR GPL-2.0-only", True),
        ("MIT AND GPL-2.0", "MIT AND GPL-2.0-only", False),
        ("MIT OR Apache-2.0 AND GPL-3.0-only", "MIT OR (Apache-2.0 AND GPL-3.0-only)", True),
        ("(MIT OR GPL-3.0-only) AND Apache-2.0.", "(MIT OR GPL-3.0-only) AND Apache-2.0", True),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", False),
        ("(MIT AND", "", None),
        ("Unknown-1.0 and then prose", "unknown-1.0", False),
    ],
)
def test_expressions(text, shown, ok):
    _, expressions, verdict = scan(f"x SPDX-License-Identifier: {text}", GOOD)
    assert (expressions, verdict) == ([shown] if shown else [], ok)


def test_shunting_yard_equals_python_precedence():
    rng = random.Random(2)
    names = ["mit", "gpl-3.0-only", "apache-2.0", "mpl-2.0"]
    value = {"mit": True, "gpl-3.0-only": False, "apache-2.0": True, "mpl-2.0": False}

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(names)
        inner = f"{make(depth - 1)} {rng.choice(['and', 'or'])} {make(depth - 1)}"
        return f"( {inner} )" if rng.random() < 0.5 else inner

    for _ in range(300):
        text = make(4)
        words = lexemes(" " + text.replace("( ", "(").replace(" )", ")"), 0)
        python = " ".join(str(value[w]) if w in value else w for w in text.split())
        assert evaluate(words, GOOD)[1] == eval(python)
        assert len(postfix(words)) == sum(w not in "()" for w in words)


def test_notices_against_a_plain_search():
    for name, wordings in NOTICES.items():
        for w in wordings:
            assert name in scan(f"Under the {w.upper()}, in short", GOOD)[0]
            assert scan(f"x{w}x", GOOD)[0] == [] or any(w != v and v in w for v in itertools.chain(*NOTICES.values()))


def test_table_cases(docs):
    rows = [(0, None), (1, ""), (2, "no licence"), (None, "MIT License"), (3, "filler " * 100000 + "MIT   license and Apache License, Version 2.0"), (3, "all rights reserved")]
    df = docs(rows).withColumns({c: F.lit(1) for c in ("licenses", "accepted", "expressions")})
    got = license_scan(df).collect()
    assert len(got) == 6 and [r["accepted"] for r in got] == [None, None, None, True, True, False]
    assert got[4]["licenses"] == ["MIT", "Apache-2.0"] and got[0]["licenses"] == []
    assert license_scan(docs([])).count() == 0
