"""Rules, points, joiners, guards and breakpoints on small books."""

import pytest

from quirework.operators.check import score_candidates, segment_stats, validate_segments, validation_summary
from quirework.operators.segment import line_native, native_points, scanned_points, segment_pages
from quirework.plans.config import Options, Rule
from quirework.sources.pages import PAGES


@pytest.fixture(scope="module")
def book(spark):
    def make(texts, ids=None, name="b"):
        return spark.createDataFrame([(name, k, (ids or range(1, len(texts) + 1))[k - 1], t) for k, t in enumerate(texts, 1)], PAGES)

    return make


@pytest.fixture(scope="module")
def cut(book):
    def run(texts, options, ids=None):
        rows = segment_pages(book(texts, ids), options).orderBy("seg_seq").collect()
        return [(r["content"], r["from_id"], r["to_id"], r["meta"]) for r in rows]

    return run


def contents(rows):
    return [r[0] for r in rows]


def test_line_starts_keep_or_strip_the_marker(cut):
    texts = ["intro\n## A\nbody", "more\n## B\nlast"]
    assert cut(texts, {"rules": [{"lineStartsWith": ["## "]}]}) == [("intro", 1, None, {}), ("## A\nbody more", 1, 2, {}), ("## B\nlast", 2, None, {})]
    assert contents(cut(texts, {"rules": [{"lineStartsAfter": ["## "]}]})) == ["intro", "A\nbody more", "B\nlast"]


def test_split_after_line_end(cut):
    assert contents(cut(["one.\ntwo\nthree.\nfour"], {"rules": [{"lineEndsWith": ["\\."], "split": "after"}]})) == ["one.", "\ntwo\nthree.", "\nfour"]


def test_named_captures_and_static_meta(cut):
    rows = cut(["٣ - الأول\n١٢ - الثاني"], {"rules": [{"lineStartsAfter": ["{{raqms:num}} {{dash}} "], "meta": {"type": "entry"}}]})
    assert [(r[0], r[3]) for r in rows] == [("الأول", {"num": "٣", "type": "entry"}), ("الثاني", {"num": "١٢", "type": "entry"})]


def test_positional_capture_is_the_content(cut):
    assert contents(cut(["Q: who?\nA: me"], {"rules": [{"regex": "^Q: (.*)$"}]})) == ["who?"]


def test_fuzzy_heading_by_default(cut):
    assert contents(cut(["مقدمة\nبَابُ الصلاة\nنص"], {"rules": [{"lineStartsWith": ["{{bab}} "]}]})) == ["مقدمة", "بَابُ الصلاة\nنص"]


@pytest.mark.parametrize(("occurrence", "want"), [("all", 4), ("first", 2), ("last", 2)])
def test_occurrence_is_per_book(cut, occurrence, want):
    assert len(cut(["x\n# a", "# b\n# c"], {"rules": [{"lineStartsWith": ["# "], "occurrence": occurrence}]})) == want


def test_page_bounds_exclusions_and_dropped_preamble(cut):
    texts = ["# a", "# b", "# c", "# d"]
    assert contents(cut(texts, {"rules": [{"lineStartsWith": ["# "], "min": 2, "exclude": [[3, 3]]}]})) == ["# b # c", "# d"]
    assert contents(cut(texts, {"rules": [{"lineStartsWith": ["zz"], "min": 2}]})) == ["# a # b # c # d"]


def test_page_start_guard_and_stoplists(cut):
    texts = ["one ends.", "# a", "goes on", "# b"]
    assert contents(cut(texts, {"rules": [{"lineStartsWith": ["# "], "pageStartGuard": "{{tarqim}}"}]})) == ["one ends.", "# a goes on # b"]
    arabic = ["هذا من", "باب أول", "تم.", "باب ثان"]
    assert contents(cut(arabic, {"rules": [{"lineStartsWith": ["باب"], "fuzzy": False, "pageStartPrevWordStoplist": ["من"]}]})) == ["هذا من باب أول تم.", "باب ثان"]


def test_first_rule_wins_at_one_place_and_metadata_unite(cut):
    rows = cut(["## x y"], {"rules": [{"lineStartsWith": ["## "], "meta": {"a": "1"}}, {"regex": "^## (?<w>x)", "meta": {"b": "2"}}]})
    assert rows[0][3] == {"a": "1", "b": "2", "w": "x"}


def test_native_and_scanned_points_agree(spark, book):
    rules = Options.of({"rules": [{"lineStartsWith": ["# ", "== "]}, {"lineEndsWith": ["!"], "split": "after"}, {"lineStartsAfter": ["- "], "max": 2}]}).rules
    assert all(map(line_native, rules))
    pages = book(["# a!\n- b\nplain!", "== c\n- d! \n# e", "- f\nx!"])
    shape = lambda df: sorted((r["page_seq"], r["local"], r["ord"], r["offset"]) for r in df.collect())
    assert shape(native_points(pages, rules)) == shape(scanned_points(pages, rules))


def test_what_may_span_lines_is_scanned():
    for spelling in ("\n", r"\n", r"\x0A", r"\u000A", r"\R", r"\s", r"[^x]", r"\W", r"[\t-\r]", r"(?s:.)", r"\012", "\t"):
        assert not line_native(_Raw(f"^(?:a{spelling}b)")), spelling
    for plain in ("a b", r"\d+\.", "# ", r"\w+:", "{{raqms:n}} {{dash}} ", r"\u0627b"):
        assert line_native(Rule("lineStartsWith", (plain,), fuzzy=False)), plain


class _Raw(Rule):
    """A line rule whose pattern is taken as it is."""

    def __init__(self, source):
        super().__init__("lineStartsWith", (source,))

    def source(self):
        return self.patterns[0]


def test_rules_with_line_breaks_match_across_lines(cut):
    for spelling in ("\n", r"\n", r"\x0A", r"\u000A"):
        assert contents(cut(["a\nb\na c"], {"rules": [{"lineStartsWith": [f"a{spelling}b"]}, {"lineStartsWith": ["a c"]}]})) == ["a\nb", "a c"], spelling


def test_stop_words_are_found_however_far_back(cut):
    noise = "١ " * 1000
    rule = {"lineStartsWith": ["باب"], "fuzzy": False}
    assert contents(cut([f"هذا من {noise}", "باب أول"], {"rules": [rule | {"pageStartPrevWordStoplist": ["من"]}]})) == [f"هذا من {noise} باب أول"]
    assert len(contents(cut([f"هذا من\n{noise}\nباب أول"], {"rules": [rule | {"samePagePrevWordStoplist": ["من"]}]}))) == 1
    assert len(contents(cut([f"هذا من {'x' * 5000}", "باب أول"], {"rules": [rule | {"pageStartPrevWordStoplist": ["من"]}]}))) == 1
    assert len(contents(cut([f"هذا {'كلمة' * 500}", "باب أول"], {"rules": [rule | {"pageStartPrevWordStoplist": ["من"]}]}))) == 2


def test_page_pieces_equal_the_worker_s(spark, book):
    from quirework.operators.segment import assembled, cut as cut_at, page_pieces, split_points
    from quirework.operators.breaks import Breaker

    texts, ids = ["a ", " ", "b\nc", "", "d", " e", "\n", "f"], [1, 2, 4, 5, 6, 9, 10, 12]
    for most in (0, 1, 3, 6, 20):
        o = Options.of({"maxPages": most, "breakpoints": [""]})
        segs = assembled(cut_at(book(texts, ids), split_points(book(texts, ids), o), o), o)
        got = [(r["content"], r["from_id"], r["to_id"]) for r in page_pieces(segs, o).orderBy("piece").collect()]
        want = [(p.content, ids[p.first], ids[p.last] if p.last != p.first else None) for p in Breaker(o).pieces(ids, texts)]
        assert got == want, most


def test_newline_joiner_crlf_and_preprocess(cut):
    assert contents(cut(["# a\r\nb", "c..."], {"rules": [{"lineStartsWith": ["# "]}], "pageJoiner": "newline", "preprocess": ["condenseEllipsis"]})) == ["# a\nb\nc…"]


def test_blank_books_vanish_and_books_without_points_stay_whole(spark, book):
    both = book(["", " \n"], name="blank").union(book(["p", "q"], name="plain"))
    rows = segment_pages(both, {"rules": [{"lineStartsWith": ["# "]}]}).collect()
    assert [(r["book_id"], r["content"]) for r in rows] == [("plain", "p q")]
    assert segment_pages(book([]), {"rules": [{"lineStartsWith": ["# "]}]}).count() == 0


@pytest.mark.parametrize(("max_pages", "want"), [(0, ["a", "b", "c", "d"]), (1, ["a", "b", "c d"]), (2, ["a", "b c d"]), (9, ["a b c d"])])
def test_page_boundary_breaks(cut, max_pages, want):
    assert contents(cut(["a", "b", "c", "d"], {"maxPages": max_pages, "breakpoints": [""]})) == want


def test_pages_are_told_by_ids_not_places(cut):
    assert contents(cut(["a", "b", "c"], {"maxPages": 1, "breakpoints": [""]}, ids=[1, 5, 6])) == ["a", "b c"]


def test_longer_and_shorter_breaks(cut):
    texts = ["One. Two. Three", "four"]
    assert contents(cut(texts, {"maxPages": 0, "breakpoints": ["{{tarqim}}\\s*"]}))[0] == "One. Two."
    assert contents(cut(texts, {"maxPages": 0, "breakpoints": ["{{tarqim}}\\s*"], "prefer": "shorter"}))[0] == "One."


def test_word_breaks_and_length_limits(cut):
    texts = ["alpha beta ثم gamma delta " * 10]
    for options in ({"maxContentLength": 60, "breakpoints": [{"words": ["ثم "]}]}, {"maxContentLength": 60}):
        rows = contents(cut(texts, options))
        assert all(len(r) <= 60 for r in rows) and " ".join(rows).split() == texts[0].split()
    assert all(r.startswith("ثم") for r in contents(cut(texts, {"maxContentLength": 60, "breakpoints": [{"words": ["ثم "]}]}))[1:])


def test_joined_emoji_is_not_torn(cut):
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    assert all(not c.startswith("‍") for c in contents(cut(["x" * 49 + family * 30], {"maxContentLength": 50})))


def test_breakpoints_alone_do_nothing_and_only_the_first_piece_has_meta(cut):
    assert contents(cut(["a. b"], {"breakpoints": ["{{tarqim}}"]})) == ["a. b"]
    rows = cut(["# a", "b", "c"], {"rules": [{"lineStartsWith": ["# "], "meta": {"k": "v"}}], "maxPages": 0, "breakpoints": [""]})
    assert [r[3] for r in rows] == [{"k": "v"}, {}, {}]


def test_wrong_options_are_refused():
    for bad in ({"rules": [{}]}, {"rules": [{"regex": "a", "template": "b"}]}, {"rules": [{"regex": "("}]}, {"maxContentLength": 10}, {"pageJoiner": "x"}, {"rules": [{"regex": "a", "split": "before"}]}, {"breakpoints": [{"words": ["a"], "regex": "b"}]}):
        with pytest.raises(ValueError):
            Options.of(bad)
    assert Rule.of({"lineStartsWith": "x"}).patterns == ("x",)


def test_validation_finds_what_was_damaged(spark, book):
    pages, options = book(["alpha\nbeta", "gamma"]), {"maxPages": 0, "breakpoints": [""]}
    good = segment_pages(pages, options)
    assert validation_summary(validate_segments(pages, options, good), good).first().asDict() == {"segments": 2, "issues": 0, "errors": 0, "warnings": 0, "ok": True}
    bad = spark.createDataFrame([("b", 1, "nowhere", 1, None), ("b", 2, "gamma", 1, None), ("b", 3, "alpha", 7, None), ("b", 4, "alpha\nbeta gamma", 1, 2)], "book_id string, seg_seq int, content string, from_id long, to_id long")
    got = {(r["seg_seq"], r["type"]) for r in validate_segments(pages, options, bad).collect()}
    assert got == {(1, "content_not_found"), (2, "page_attribution_mismatch"), (3, "page_not_found"), (4, "max_pages_violation")}


def test_validation_by_joined_content(spark, book):
    """Damaged tails, overrun ends, wrong ``to``, other pages, repeated texts, empty contents."""
    schema = "book_id string, seg_seq int, content string, from_id long, to_id long"
    judge = lambda texts, options, rows, ids=None: {(r["seg_seq"], r["type"], r["found_id"], r["actual_to"]) for r in validate_segments(book(texts, ids), options, spark.createDataFrame([("b", *r) for r in rows], schema)).collect()}
    assert judge(["alpha\nbeta", "gamma"], {"maxPages": 0}, [(1, "alpha\nNOT THERE AT ALL", 1, None), (2, "alpha\nbeta gamma", 1, None), (3, "", 1, None), (4, "gamma", 2, None)]) == {(1, "content_not_found", None, None), (2, "max_pages_violation", None, 2), (3, "content_not_found", None, None)}
    assert judge(["He", "llo"], {}, [(1, "He llo", 1, 1), (2, "He llo", 1, 2)]) == {(1, "max_pages_violation", None, 2)}
    assert judge(["P0", "P1", "P2"], {"maxPages": 1}, [(1, "P0 P1 P2", 1, None), (2, "P0 P1", 1, 2), (3, "P0\nP1\nP2", 1, 3)]) == {(1, "max_pages_violation", None, 3), (3, "max_pages_violation", None, 3), (3, "content_not_found", None, 3)}
    assert judge(["same", "same", "other"], {"maxPages": 0}, [(1, "same", 30, None), (2, "same", 20, None), (3, "other", 20, None)], [10, 20, 30]) == {(1, "page_attribution_mismatch", 10, None), (3, "page_attribution_mismatch", 30, None)}
    far = ["x" * 600, *["filler " * 300] * 2, "last"]
    assert judge(far, {}, [(1, "x" * 600, 4, None), (2, "last", 1, None), (3, "last", 4, 9)]) == {(1, "content_not_found", None, None), (2, "page_attribution_mismatch", 4, None), (3, "page_not_found", None, 9)}


def test_scores_and_stats(book):
    pages = book(["a", "b", "c"])
    rows = score_candidates(pages, [{"maxPages": 0, "breakpoints": [""]}, {"rules": [{"regex": "("}]}, {"maxPages": 5}]).orderBy("index").collect()
    assert [r["score"] for r in rows] == [3.0, float("-inf"), -4.0] and [r["best"] for r in rows] == [True, False, False]
    assert segment_stats(segment_pages(pages, {"maxPages": 0, "breakpoints": [""]})).first().asDict() == {"segment_count": 3, "average_length": 1.0, "max_length": 1, "multi_page": 0}


def test_debug_provenance(book):
    from quirework.functions.debug import explain

    rows = segment_pages(book(["# a", "b"]), {"rules": [{"lineStartsWith": ["# "]}], "maxPages": 0, "breakpoints": [""], "debug": True}).orderBy("seg_seq").collect()
    assert rows[0]["prov"]["rule"]["type"] == "lineStartsWith" and rows[0]["prov"]["breakpoint"]["index"] == 0
    assert explain(None) == "-" and explain({"rule": {"index": 0, "type": "regex"}}, concise=True) == "rule 0"
