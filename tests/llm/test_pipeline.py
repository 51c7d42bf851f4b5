"""The pipeline against a step-by-step recomputation, and the registry's SQL on whole tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import queries as registry
from quirework.llm import tokens

from .test_decontam import SuffixAutomaton, tokens_of
from .test_linededup import brute as line_brute
from .test_neardup import brute_groups, keyless_pairs

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, sf_dir).collect(), docs.schema)
        steps[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = steps["quality_rules"]
    assert all(original[i] == t for i, t in kept.items())
    lines = {i: t for i, t in line_brute(sorted(kept.items())).items() if t.strip()}
    assert steps["line_dedup"] == lines
    gone = brute_groups(sorted(lines.items()))
    assert steps["near_dedup"] == {i: t for i, t in lines.items() if i not in gone}
    items = [(r["item_id"], tokens_of(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    automaton = SuffixAutomaton(items)
    for i, t in steps["decontaminate"].items():
        assert not [r for r in automaton.runs(tokens_of(t), 13)]
        if not automaton.runs(tokens_of(steps["near_dedup"][i]), 6):
            assert t == steps["near_dedup"][i]
    ids = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        flat = np.frombuffer(r["ids"], tokens.id_type(tokens.TOKENIZER))
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            ids.setdefault(d, {})[s] = flat[a:b]
    whole = {d: tokens.decode(np.concatenate([p[s] for s in sorted(p)]), tokens.TOKENIZER).decode() for d, p in ids.items()}
    assert whole == {i: t for i, t in steps["decontaminate"].items() if t}


def test_stages_handle_odd_rows(spark, sf_dir, docs):
    """Null ids and texts, empty and repeated rows, clashing and extra columns, an empty table: stage by stage."""
    run = "\n".join(f"line {k} of a run that two documents share" for k in range(4))
    rows = [(None, "a text of its own without an id"), (1, None), (2, ""), (3, run), (4, f"opening words here\n{run}"), (5, "x" * 50_000), (5, "x" * 50_000), (6, " \n")]
    odd = docs(rows).withColumns({c: F.lit(c) for c in ("rank", "p_quality", "removed_spans", "id", "key", "gone", "qw_id")})
    want = {"quality_rules": rows, "line_dedup": [r if r[0] != 4 else (4, "opening words here") for r in rows if r[0] != 6] + [rows[-1]]}
    want["near_dedup"] = want["decontaminate"] = want["line_dedup"]
    at = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == odd.columns
        got = at.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want[name], key=str), name
        assert all(r["rank"] == "rank" and (r["text"] is None or r["n_chars"] == len(r["text"])) for r in got)
        at = spark.createDataFrame(got, odd.schema)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    packed = corpus_pipeline.pack(spark, at, sf_dir).collect()
    assert sorted({d for r in packed for d in r["doc_ids"]}, key=str) == sorted([None, 3, 4, 5, 6], key=str)
    assert corpus_pipeline.pack(spark, odd.limit(0), sf_dir).count() == 0


def test_near_dedup_leaves_no_near_pair(spark, sf_dir, docs):
    """Also of pairs that agree on none of the keys which the stage once compared by."""
    rows = keyless_pairs() + [(None, "a text of its own without an id"), (100_000, "another text that is like none of them")]
    gone = brute_groups([r for r in rows if r[0] is not None])
    assert len(gone) >= 3
    left = corpus_pipeline.near_dedup(spark, docs(rows), sf_dir).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in left) == sorted((i is None, i, t) for i, t in rows if i not in gone)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.select(", ".join(columns)).fetchall()))
