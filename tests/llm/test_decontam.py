"""Suffix automaton and span removal against brute force over all token runs."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quirework.llm.decontam import Limits, SuffixAutomaton, decontaminate, maybe_matching, spans_of, tokens_of, without
from quirework.llm.textbatch import fold, word_pattern


def brute_runs(items, words, least):
    """Maximal runs, with the items that hold each."""
    grams = {}
    for i, w in items:
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                grams.setdefault(tuple(w[a:b]), set()).add(i)
    spans = []
    for a in range(len(words)):
        b = a
        while b < len(words) and tuple(words[a : b + 1]) in grams:
            b += 1
        if b - a >= least and not (a and spans and spans[-1][1] >= b):
            spans.append((a, b, grams[tuple(words[a:b])]))
    return spans


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        items = [(i, [rng.choice("abc") for _ in range(rng.randint(1, 12))]) for i in range(4)]
        words = [rng.choice("abcd") for _ in range(60)]
        assert SuffixAutomaton(items).runs(words, 3) == brute_runs(items, words, 3)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEM = "What is the name of the large river that runs through the old city of stone?"


def test_passages_go_and_clean_text_stays(spark, docs):
    clean = "Nothing here has been taken from any test."
    rows = [(0, f"Before it. {ITEM.upper()} After it."), (1, clean), (2, f"Begin\n{ITEM}\nend"), (3, "what is the name of the large fish"), (4, None), (5, ""), (6, ITEM)]
    out = {r["doc_id"]: r for r in decontaminate(docs(rows), bench(spark, [(7, ITEM), (None, "one two three four five six seven"), (8, None)])).collect()}
    assert out[0]["text"] == "Before it. After it." and out[0]["n_chars"] == len(out[0]["text"])
    assert out[1]["text"] == clean and out[1]["removed_spans"] == []
    assert out[2]["text"] == "Begin\nend"
    assert out[3]["text"] == rows[3][1]  # seven tokens of sixteen: under both limits
    assert out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == ""
    assert [s["item_id"] for s in out[0]["removed_spans"]] == [7]


def test_coverage_limit(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    text = "so alpha beta gamma delta epsilon zeta it goes"
    out = decontaminate(docs([text]), bench(spark, [(1, item)])).first()
    assert out["text"] == "so it goes"
    assert decontaminate(docs([text]), bench(spark, [(1, item + " " + item)]), Limits(13, 6, 0.9)).first()["text"] == text


def test_shards_find_what_one_automaton_finds(spark, docs):
    rng = random.Random(2)
    pool = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(20))) for i in range(12)]
    texts = [" ".join(rng.choice(pool) for _ in range(10)) + " " + items[k % 12][1] + " tail" for k in range(20)]
    one = decontaminate(docs(texts), bench(spark, items)).orderBy("doc_id").select("text").collect()
    many = decontaminate(docs(texts), bench(spark, items), max_shard_chars=150).orderBy("doc_id").select("text").collect()
    assert one == many
    assert all(" ".join(items[k % 12][1].split()) not in r["text"] for k, r in enumerate(one))


def test_empty_tables_clashing_columns_and_long_text(spark, docs):
    assert decontaminate(docs([]), bench(spark, [(1, ITEM)])).count() == 0
    df = docs(["filler words here " * 50000 + ITEM]).withColumns({"removed_spans": F.lit(1), "item_id": F.lit("x")})
    out = decontaminate(df, bench(spark, [(1, ITEM)]))
    assert out.columns == [*df.columns, "removed_spans_1"]
    assert "river" not in out.first()["text"] and out.first()["item_id"] == "x"
    assert decontaminate(docs(["a b"]), bench(spark, [])).first()["text"] == "a b"


def test_without_merges_overlaps():
    assert without("a bb cc dd e", [{"start": 2, "end": 7}, {"start": 5, "end": 10}]) == ("a e", 9)
    assert tokens_of("It's 3-fold") == ["it", "s", "3", "fold"]


def test_each_item_counts_as_if_alone(spark, docs):
    rng = random.Random(8)
    for _ in range(60):
        items = [(i, [rng.choice("abc") for _ in range(rng.randint(1, 12))]) for i in range(4)]
        words = [rng.choice("abcd") for _ in range(60)]
        want = sorted((a, b, i) for i, w in items for a, b, _ in brute_runs([(i, w)], words, 3))
        assert sorted(SuffixAutomaton(items).item_runs(words, 3)) == want
    shared = " ".join(f"t{k}" for k in range(1, 11))
    long = " ".join(f"u{k}" for k in range(49))
    items = [(1, f"x {shared} {long}"), (2, f"{shared} z1 z2")]
    for shard in (1_000_000, 10):
        out = decontaminate(docs([f"so x {shared} q"]), bench(spark, items), max_shard_chars=shard).first()
        assert out["text"] == "so x q" and [s["item_id"] for s in out["removed_spans"]] == [2]


SCRIPTS = [(0x41, 0x7A), (0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x587), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0x97F), (0x10A0, 0x10FF), (0x13A0, 0x13FF), (0x1C80, 0x1C8A), (0x1E00, 0x1FFF), (0x2160, 0x2188), (0x24B6, 0x24E9), (0x2C00, 0x2DFF), (0xA640, 0xA7FF), (0xFF21, 0xFF5A), (0x10400, 0x1044F), (0x16E40, 0x16E7F), (0x1E900, 0x1E943), (0x0, 0x40), (0x2000, 0x206F)]


def _filter(texts, automaton, least):
    table = np.zeros(1 << 20, bool)
    table[automaton.pairs * 0x9E3779B97F4A7C1 >> 20 & len(table) - 1] = True
    return set(maybe_matching(pa.array(texts, pa.string()), automaton, pa.array(list(automaton.vocab), pa.string()), table, least).tolist())


def test_the_filter_misses_nothing_in_any_script():
    rng = random.Random(4)
    for low, high in SCRIPTS * 2:
        chars = [chr(c) for c in range(low, high + 1)]
        word = lambda chars=chars: "".join(rng.choice(chars) for _ in range(rng.randint(1, 6)))
        items = [" ".join(word() for _ in range(12)) for _ in range(6)]
        automaton = SuffixAutomaton([(i, tokens_of(t)) for i, t in enumerate(items)])
        texts = []
        for _ in range(40):
            t = rng.choice(items)
            t = rng.choice([str, str.upper, str.lower, str.swapcase, str.title])(t)
            texts.append(f"{word()} {rng.choice(['', '-', '(', chr(0xA0)])}{t}{rng.choice(['.', ' ', chr(10)])}{word()}")
        found = _filter(texts, automaton, 6)
        assert {r for r, t in enumerate(texts) if spans_of(t, automaton, Limits())} <= found, hex(low)
    greek = "ΟΔΟΣ ΑΝΘΡΩΠΟΣ ΚΑΙ ΛΟΓΟΣ ΤΗΣ ΓΗΣ ΠΟΛΕΩΣ ΜΕΓΑΣ ΝΟΜΟΣ ΤΩΝ ΦΙΛΩΝ ΕΙΣ ΤΟΝ ΑΙΩΝΑ"
    automaton = SuffixAutomaton([(1, tokens_of(greek))])
    for text in (greek, greek.lower(), greek.title()):
        assert spans_of(text, automaton, Limits()) and _filter([text], automaton, 6) == {0}, text


def test_filter_and_automaton_see_the_same_words():
    every = pa.array([chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF], pa.string())
    word = np.asarray(pc.match_substring_regex(fold(every), r"[\p{L}\p{M}\p{N}]"))
    assert [bool(word_pattern().fullmatch(c)) for c in every.to_pylist()] == word.tolist()
    assert unicodedata.unidata_version  # Python's own tables play no part


def brute_spans(text, items, limits):
    """Spans for each item alone, from its maximal runs by brute force."""
    found = list(word_pattern().finditer(text))
    words = tokens_of(text)
    out = set()
    for name, item in items:
        runs = [(a, b) for a, b, _ in brute_runs([(0, item)], words, min(limits.min_span, limits.max_span))]
        covered = {k for a, b in runs if b - a >= limits.min_span for k in range(a, b)}
        heavy = len(covered) >= limits.max_coverage * len(item)
        out |= {(found[a].start(), found[b - 1].end(), name) for a, b in runs if b - a >= limits.max_span or b - a >= limits.min_span and heavy}
    return sorted(out)


def test_spans_match_brute_force():
    rng = random.Random(12)
    for k in range(80):
        pool = "abc" if k % 2 else "abcdefgh"
        items = [(rng.choice([7, 8, -1]), [rng.choice(pool) for _ in range(rng.randint(3, 20))]) for _ in range(5)]
        parts = [" ".join(rng.choice(items)[1][rng.randint(0, 5) :]) for _ in range(4)]
        text = ", ".join(p if rng.random() < 0.7 else " ".join(rng.choice(pool + "z") for _ in range(8)) for p in parts)
        limits = Limits(rng.choice([4, 6, 13]), rng.choice([2, 3, 6]), rng.choice([0.2, 0.5, 0.9]))
        got = [(s["start"], s["end"], s["item_id"]) for s in spans_of(text, SuffixAutomaton(items), limits)]
        assert got == brute_spans(text, items, limits), (text, items, limits)


def test_null_and_repeated_item_ids_are_judged_apart(spark, docs):
    short, long = "one two three four five six seven eight", " ".join(f"w{k}" for k in range(60))
    for ids in ((None, None), (3, 3), (3, 4)):
        for shard in (1_000_000, 10):
            out = decontaminate(docs(["so one two three four five six it goes"]), bench(spark, [(ids[0], short), (ids[1], long)]), max_shard_chars=shard).first()
            assert out["text"] == "so it goes" and [s["item_id"] for s in out["removed_spans"]] == [-1 if ids[0] is None else ids[0]]
