"""Prefix trees: every conversation's ids can be read back from the node it ends at."""

import random

from pyspark.sql import functions as F

from quirework.llm import tokens
from quirework.llm.chat import format_chats, render, replay

SCHEMA = "conv_id long, turn int, role string, text string"


def conversations(rows):
    out = {}
    for c, t, r, x in sorted({(c, t, r or "", x or "") for c, t, r, x in rows if c is not None and t is not None}):
        out.setdefault(c, []).append((r, x))
    return out


def check(rows, out):
    kind = tokens.id_type(tokens.TOKENIZER)
    paths = {tuple(turns[: k + 1]) for turns in conversations(rows).values() for k in range(len(turns))}
    assert len(out) == len(paths)  # each shared opening once
    seen = set()
    for r in out:
        assert r["n_ids"] * kind.itemsize == len(r["ids"])
        seen.add(replay(out, r["tree_id"], r["start"], kind))
        assert r["position"] == sum(i["end"] - i["start"] for i in r["attends"])
    want = {b"".join(tokens.encode(render(*t), tokens.TOKENIZER).tobytes() for t in p) for p in paths}
    assert seen == want
    for tree in {r["tree_id"] for r in out}:
        own = sorted((r["start"], r["n_ids"], r["depth"]) for r in out if r["tree_id"] == tree)
        at = 0
        for k, (start, n, depth) in enumerate(own):
            assert start == at and (k == 0) == (depth == 0) and (not k or depth <= own[k - 1][2] + 1)  # depth first, no gaps
            at += n


def test_random_trees(spark):
    rng = random.Random(8)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab") if t else rng.choice("xyz")))
    check(rows, [r.asDict(True) for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()])


def test_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 5, "bot", None), (2, 0, "user", "hi"), (None, 0, "user", "x"), (3, None, "user", "x"), (4, 0, None, ""), (5, 1, "user", "z"), (5, 1, "bot", "y"), (6, 0, "user", "long " * 50000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("depth", "node", "tree", "rank", "ids", "path")})
    out = [r.asDict(True) for r in format_chats(df).collect()]
    check(rows, out)
    shared = next(r for r in out if r["tree_id"] == 1 and r["depth"] == 0)
    assert shared["conversations"] == 2 and shared["conv_id"] == 2  # the shorter path comes first
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
