"""What is shuffled and held stays small as tables grow: sequences, line starts, detection, normalising, the lexicon."""

import time
from collections import Counter

import pyarrow as pa
import pytest

from quirework.functions import text as X
from quirework.operators import detect, lexicon, mine
from quirework.plans import advisor, profiles
from quirework.sources.pages import PAGES


@pytest.fixture(scope="module")
def book(spark):
    return lambda texts: spark.createDataFrame([("b", k, k, t) for k, t in enumerate(texts, 1)], PAGES)


def test_advice_counts_patterns_however_many_come_before(book):
    """1100 other patterns are seen first; the most frequent sequence comes after them."""
    pages = book([f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}. " for k in range(1100)] + ["late! "] * 2000)
    found = {r["pattern"]: r["count"] for r in advisor.suggest_options(pages, max_rules=1)["repeating_sequences"]}
    assert found["late\\s*{{tarqim}}"] == 2000


def test_advice_keeps_no_pages(book, spark):
    """nothing is persisted while the report is made."""
    from pyspark.sql import DataFrame

    def refuse(*_):
        raise AssertionError("persisted")

    kept, DataFrame.persist = DataFrame.persist, refuse
    classic = type(book(["x"]))
    own, classic.persist = classic.__dict__.get("persist"), refuse
    try:
        assert advisor.suggest_options(book([f"The one {k}.\nOf two" for k in range(6)]))["recommended_options"]["rules"]
    finally:
        DataFrame.persist = kept
        if own:
            classic.persist = own
        else:
            del classic.persist


def test_sequences_are_counted_by_hashes_first(book, monkeypatch):
    """hashes and numbers are all that is shuffled of patterns that aren't among the first."""
    texts = [f"a b. a b w{k % 7}x. c d{k}" for k in range(60)]
    pages = book(texts).repartition(3)
    want = Counter()
    for t in texts:
        items = [i["text"] for i in mine.stream(t)]
        want.update("\\s*".join(items[k : k + n]) for n in (1, 2) for k in range(len(items) - n + 1))
    ask = lambda: [(r["pattern"], r["count"]) for r in mine.repeating_sequences(pages, 1, 2, 2, 9, require_token=False, max_unique_patterns=None, max_examples=0).collect()]
    by_hash = ask()
    assert all(want[p] == n for p, n in by_hash) and [n for _, n in by_hash] == sorted(want.values(), reverse=True)[:9]
    keep = mine._often(pages, 1, 2, False, True, 2, 9)
    assert 9 <= len(keep) < len(want)
    kept = mine._grams(pages, 1, 2, "\\s*", False, 1, True, keep)
    assert {r["pattern"] for r in kept.select("pattern").collect()} == {p for p, n in want.items() if n >= by_hash[-1][1]}
    monkeypatch.setattr(mine, "MORE", 0)  # more ties than may be told: all are counted as they are
    assert mine._often(pages, 1, 2, False, True, 2, 9) is None and ask() == by_hash
    monkeypatch.setattr(mine, "_often", lambda *_: keep[:-1].copy())  # fewer hashes than patterns, as if two shared one
    monkeypatch.setattr(mine, "_grams", lambda p, low, high, glue, token, examples, marks, some, f=mine._grams: f(p, low, high, glue, token, examples, marks, keep if some is not None else None))
    assert ask() == by_hash


def test_hashes_are_the_same_in_all_slices():
    a, b = mine._Codes(), mine._Codes()
    one = mine._Slice([("b", 1, 1, a.items("x y z x y", True))], a)
    two = mine._Slice([("b", 1, 1, b.items("q z x y", True))], b)
    h1, n1 = one.sums(2, 2, False)
    h2, n2 = two.sums(2, 2, False)
    both = dict(zip(*map(list, mine._summed([h1, h2], [n1, n2]))))
    assert sorted(both.values()) == [1, 1, 2, 3] and len(h1) == 3


def test_line_starts_are_counted_in_the_workers(book):
    """a row for each pattern of a worker, not for each line."""
    pages = book([f"The line {k}\nOf another\n  odd  white\tspace {k}" for k in range(500)]).coalesce(1)
    rows = mine._first_lines(pages).collect()
    assert {(r["pattern"], r["count"], r["line"]) for r in rows} == {("The", 500, "The line 0"), ("Of", 500, "Of another"), ("odd", 500, "odd white space 0")} and len(rows) == 3
    assert mine.line_signatures(pages).count() == 1500


def test_texts_are_normalised_in_parts():
    """a batch's texts aren't Python's strings all at once."""
    texts = ["ü" * 5000, None, ""] * 1000
    parts = list(X.composed(iter([pa.array(texts)])))
    assert max(p.nbytes for p in parts) <= X.PART_BYTES and len(parts) > 2
    assert [t for p in parts for t in p.to_pylist()] == ["ü" * 5000, None, ""] * 1000


def test_tokens_are_counted_in_the_workers(book):
    """what a worker sends of its texts is a number for each token."""
    pages = book(["a. b! 12 - c"] * 300).coalesce(1)
    plan = detect.token_counts(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
    assert {r["token"]: r["count"] for r in detect.token_counts(pages).collect()} == {t: n * 300 for t, n in Counter(d["token"] for d in detect.detect("a. b! 12 - c")).items()}


def test_a_candidate_costs_the_same_with_many_stop_words():
    """F4, F5, F7, F8: stop words are put in their form once, not at each candidate."""

    def seconds(words):
        zone = {"name": "all", "families": [profiles.ENTRY], "blockers": [{"use": "stopLemma", "words": words}]}
        finder = lexicon.Finder({"version": 2, "zones": [zone]})
        list(finder.found("سحب: جر", None, 0))
        began = time.thread_time()
        assert sum(reason is None for _, reason in finder.found("\n".join(["سحب: جر كثير"] * 1000), None, 0)) == 1000
        return time.thread_time() - began

    assert seconds([f"كلمة{'س' * (k % 9)}{'ص' * (k // 9)}" for k in range(400)]) < 4 * seconds(["قال"]) + 0.05
