"""Detection, mining, lexicon, configuration tools, advisor, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quirework.functions import templates as T
from quirework.functions import text as X
from quirework.functions.dialect import compile_python, for_java
from quirework.operators import detect, lexicon, mine
from quirework.operators.lexicon_rule import dictionary_entry_rule
from quirework.operators.segment import segment_pages
from quirework.plans import advisor, profiles, tooling
from quirework.sources import pages as S
from quirework.streaming import pages as streams


@pytest.fixture(scope="module")
def book(spark):
    return lambda texts: spark.createDataFrame([("b", k, k, t) for k, t in enumerate(texts, 1)], S.PAGES)


def test_templates():
    assert T.expand_tokens("{{num}}-{{none}}") == r"\d-{{none}}"
    assert T.expand("{{num:a}}{{num:a}}{{:r}}").captures == ("a", "a_2", "r")
    assert T.with_capture(T.Token.RAQMS, "n") == "{{raqms:n}}" and T.with_capture("x", "n") == "{{:n}}"
    assert T.strip_token_mappings(T.apply_token_mappings("{{num}} x", [("num", "n")])) == "{{num}} x"
    assert T.escape_brackets("({{raqms:a}}) [x]") == r"\({{raqms:a}}\) \[x\]"
    assert T.template_to_regex("(") is None and T.template_to_regex("{{raqms}}").fullmatch("٤٢")
    assert T.fuzzy_by_default("{{naql}} x") and not T.fuzzy_by_default("{{raqms}}")
    assert set(T.available_tokens()) >= {"bab", "numbered"} and T.contains_tokens("{{x}}") and T.token_pattern("no") is None


def test_diacritic_insensitive_matches_vowelled_text():
    p = compile_python(T.diacritic_insensitive("احمد")).regex
    assert p.fullmatch("أَحْمَد") and not p.fullmatch("محمد")


def test_dialects_agree(spark):
    samples = ["a1 b", "x\ty", "ab\ncd", "سلام 12", "foo_bar", " z"]
    for source in (r"^\w+", r"\s", r"\bb", r"d$", r"[^\s]+\d", r"\p{Script=Arabic}+", r"(?<a>.)(?<b>.)"):
        python = [bool(compile_python(source).regex.search(s)) for s in samples]
        java = [r[0] for r in spark.createDataFrame([(k, s) for k, s in enumerate(samples)], "k int, s string").orderBy("k").select(F.col("s").rlike(for_java(source).source)).collect()]
        assert python == java, source


def test_cleaning(spark):
    row = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c("t")).first()[0]
    assert row(X.remove_zero_width, "a​b") == "ab"
    assert row(lambda c: X.remove_zero_width(c, "space"), "​a​‍b ​c") == "a b c"
    assert row(X.condense_ellipsis, "a..b.") == "a…b." and row(X.fix_trailing_waw, "قال و ذهب") == "قال وذهب"
    assert row(X.normalize_for_comparison, " أَحمدُ  إلى‍") == X.normalize_one(" أَحمدُ  إلى‍") == "احمد الي"
    assert row(X.strip_html, "<p>a &amp; b</p><script>x</script><div>c</div>") == "a & b\nc"
    assert row(lambda c: X.preview(c, 3), "ab  cd") == "ab ..."
    some = spark.createDataFrame([(1, "a.."), (2, "a..")], "page_id long, content string").select(X.preprocess("content", "page_id", [{"type": "condenseEllipsis", "min": 2}])).collect()
    assert [r[0] for r in some] == ["a..", "a…"]


def test_detection():
    found = detect.detect("٣٤ - حدثنا")
    assert [(d["token"], d["index"]) for d in found] == [("numbered", 0), ("naql", 5)]
    assert detect.detect(None) == [] and detect.analyze_text_for_rule("abc") is None
    rule = detect.analyze_text_for_rule("باب الصلاة")
    assert rule["template"].startswith("{{bab}}") and rule["patternType"] == "lineStartsWith" and rule["metaType"] == "bab"


def test_line_starts_and_sequences(book):
    pages = book(["## heading one\nplain text here", "## heading two\nplain words here", "٣ - حدثنا فلان\n٤ - حدثنا غيره"])
    starts = {r["pattern"]: r["count"] for r in mine.common_line_starts(pages, min_count=2).collect()}
    assert starts == {"##\\s*heading": 2, "plain": 2, "{{numbered}}{{naql}}": 2}
    many = mine.common_line_starts(pages, min_count=2, max_examples=2, sort_by="count").collect()
    assert all(len(r["examples"]) == 2 for r in many)
    pairs = {r["pattern"]: r["count"] for r in mine.repeating_sequences(pages, 2, 2, 2, require_token=False).collect()}
    assert pairs == {"##\\s*heading": 2, "{{numbered}}\\s*{{naql}}": 2}
    told = mine.repeating_sequences(pages, 2, 2, 2, max_examples=2).collect()
    assert [(r["pattern"], r["count"], [e["text"] for e in r["examples"]]) for r in told] == [("{{numbered}}\\s*{{naql}}", 2, ["٣ - حدثنا", "٤ - حدثنا"])]


def test_sequences_equal_brute_force(book):
    texts = ["a b. a b. c", "b. a b - c", ""]
    want = {}
    for t in texts:
        items = [i["text"] for i in mine.stream(t)]
        for n in (1, 2, 3):
            for k in range(len(items) - n + 1):
                p = "\\s*".join(items[k : k + n])
                want[p] = want.get(p, 0) + 1
    got = {r["pattern"]: r["count"] for r in mine.repeating_sequences(book(texts), 1, 3, 1, 1000, require_token=False, max_unique_patterns=None).collect()}
    assert got == want


def test_a_long_text_is_counted_in_linear_time(book):
    text = "alpha beta. " * 33_333 + "gamma\n" * 20_000
    got = {r["pattern"]: r["count"] for r in mine.repeating_sequences(book([text]), 1, 2, 100, require_token=False, max_examples=0).collect()}
    assert got["alpha\\s*beta"] == 33_333 and got["gamma\\s*gamma"] == 19_999 and got["{{tarqim}}"] == 33_333


def test_line_offsets_of_long_pages(book):
    from quirework.operators.layout import lines

    texts = ["\n".join("x" * (k % 5) for k in range(n)) for n in (1, 127, 128, 129, 1000, 20_000)] + [""]
    got = {(r["page_seq"], r["line_no"]): (r["local"], r["line"]) for r in lines(book(texts)).collect()}
    want = {}
    for seq, t in enumerate(texts, 1):
        at = 0
        for k, line in enumerate(t.split("\n")):
            want[seq, k] = (at, line)
            at += len(line) + 1
    assert got == want


def test_headings():
    kinds = {"## باب الجيم": "chapter", "## كلمة": "entry", "## ": "noise", "## س": "marker"}
    assert {h: lexicon.classify_heading(h) for h in kinds} == kinds


def test_lexicon_entries_and_reasons(book):
    pages = book(["سحب: جر\nقال: كلام\nسلم: صلح.", "## سفر\nنص"])
    rows = segment_pages(pages, {"dictionary": profiles.PROFILES["plain"]}).orderBy("seg_seq").collect()
    assert [r["meta"].get("lemma") for r in rows] == ["سحب", "سلم", "سفر"]
    facets = lexicon.diagnose(pages, profiles.PROFILES["plain"])
    assert facets["totals"].first().asDict() == {"accepted": 3, "rejected": 1}
    assert [r["lemma"] for r in facets["rejected_lemmas"].collect()] == ["قال"]
    assert {r["kind"]: r["count"] for r in lexicon.surface_counts(pages).collect()}["lineEntry"] == 3


def test_gated_zone_opens_with_its_heading(book):
    pages = book(["سحب: قبل الباب", "## باب السين\nسقف: غطاء", "سند: عماد"])
    rows = segment_pages(pages, {"dictionary": profiles.PROFILES["front_matter"]}).collect()
    assert {r["meta"].get("lemma") for r in rows} - {None} >= {"سقف", "سند"} and "سحب" not in {r["meta"].get("lemma") for r in rows}


def test_profiles_are_valid_and_wrong_ones_are_told():
    assert all(lexicon.validate_profile(p) == [] for p in profiles.PROFILES.values())
    assert set(json.loads(profiles.export_options())) == set(profiles.PROFILES)
    bad = {"version": 1, "zones": [{"name": "", "families": [], "when": {"minPageId": 3, "maxPageId": 1}}, {"name": "", "families": [{"use": "heading", "classes": [], "emit": "entry"}], "blockers": [{"use": "stopLemma", "words": []}]}]}
    codes = {i["code"] for i in lexicon.validate_profile(bad)}
    assert codes >= {"invalid_version", "empty_zone_name", "duplicate_zone_name", "empty_zone_families", "invalid_zone_page_range", "empty_heading_classes", "inert_heading_family", "invalid_stop_words"}


def test_entry_rule(book):
    rule = dictionary_entry_rule(["قال", "قَالَ"], meta={"type": "entry"})
    assert rule["dictionaryEntry"]["stopWords"] == ["قال"]
    rows = segment_pages(book(["سحب: جر\nقال: كلام\nسلم: صلح"]), {"rules": [rule]}).orderBy("seg_seq").collect()
    assert [r["meta"].get("lemma") for r in rows] == ["سحب", "سلم"]
    with pytest.raises(ValueError):
        dictionary_entry_rule([], minLetters=0)


def test_rule_tools():
    rules, merged = tooling.optimize_rules([{"lineStartsWith": ["a"]}, {"lineStartsWith": ["bbb", "a"]}, {"template": "longest of all"}])
    assert merged == 1 and rules[0] == {"template": "longest of all"} and rules[1] == {"lineStartsWith": ["bbb", "a"]}
    found = tooling.validate_rules([{"lineStartsWith": ["{{raqms", "raqms x", "{{no}}", " ", "ok", "ok"]}, {"lineStartsWith": ["fine"]}, {"regex": "("}])
    assert [i and i["type"] for i in found[0]["lineStartsWith"]] == ["missing_braces", "missing_braces", "unknown_token", "empty_pattern", None, "duplicate"]
    assert found[1] is None and len(tooling.format_report(found)) == 6


def test_advice(book):
    pages = book([f"٣ - حدثنا شيخ رقم {k}\nنص طويل" for k in range(6)])
    report = advisor.suggest_options(pages)
    assert report["assessment"]["mode"] == "structured" and report["recommended_options"]["rules"]
    assert report["evaluation"]["segment_count"] >= 6 and report["rule_errors"] == []
    assert "Recommended options" in advisor.report_markdown(report)
    assert set(advisor.inspect_book(pages)) == {"assessment", "preprocess", "line_starts", "repeating_sequences"}


def test_sources(spark, book, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"id": 2, "content": "x"}, {"id": 5, "content": "y"}]))
    (tmp_path / "two.json").write_text(json.dumps({"pages": [{"id": 1, "content": "z"}]}))
    got = {(r["book_id"], r["page_seq"], r["page_id"], r["content"]) for r in S.read_json_books(spark, str(tmp_path)).collect()}
    assert got == {("one", 1, 2, "x"), ("one", 2, 5, "y"), ("two", 1, 1, "z")}
    bad = spark.createDataFrame([("b", 1, 0, "x"), ("b", 2, 4, ""), ("b", 3, 5, "y"), ("b", 4, 5, "z")], S.PAGES)
    assert sorted(r["problem"] for r in S.validate_book(bad).collect()) == ["duplicate_id", "duplicate_id", "empty_content", "id_not_positive"]
    have, missing = S.sample_pages(book(["a", "b"]), spark.createDataFrame([("b", 2), ("b", 9)], "book_id string, page_id long"))
    assert [r["content"] for r in have.collect()] == ["b"] and missing.first()["page_id"] == 9
    sizes = [r["rows"] for r in S.chunk_manifest(S.row_chunks(spark.range(10), 4, "id"), "id").orderBy("chunk").collect()]
    assert sizes == [3, 3, 3, 1]
    segments = segment_pages(book(["# a\nb \"q\""]), {"rules": [{"lineStartsWith": ["# "]}]})
    S.write_segments_csv(segments, str(tmp_path / "csv"))
    assert S.read_csv(spark, str(tmp_path / "csv")).first()["t"] == '# a\\nb "q"'
    assert "<table>" in S.preview_html("t", [r.asDict() for r in segments.collect()])


def test_streams(spark, tmp_path):
    rows = [("b", 1, 1, "the one\nthe two"), ("b", 2, 2, "a.")]
    spark.createDataFrame(rows, S.PAGES).write.parquet(str(tmp_path / "in"))
    stream = streams.read_pages(spark, str(tmp_path / "in"), "book_id string, page_seq long, page_id long, content string", 1)
    streams.drain(streams.detected(stream), str(tmp_path / "s"))
    out = spark.read.parquet(str(tmp_path / "s/out")).orderBy("page_seq").collect()
    assert [t["token"] for t in out[1]["tokens"]] == ["tarqim"]
    query = streams.line_starts(stream).writeStream.format("memory").queryName("starts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["start"]: r["count"] for r in spark.table("starts").collect()} == {"the": 2, "a.": 1}
    timed = stream.withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:00:10")))
    query = streams.windowed_pages(timed, "at", "1 minute", "1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").first()["pages"] == 2
