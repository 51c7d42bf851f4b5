"""Host reputation: names, shrinkage, and its defined cases (SQL checks the sums)."""

import random

from pyspark.sql import functions as F

from quirework.llm.hosts import DEFAULT, Suffixes, named, read_suffixes, url_filter

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def test_names(spark):
    urls = {"https://u:p@A.Shop.co.uk:80/x?y": ("a.shop.co.uk", "shop.co.uk", "co.uk"), "http://example.org.": ("example.org", "example.org", "org"), "http://1.2.3.4/a": ("1.2.3.4",) * 3, "nonsense": ("", "", ""), "http://localhost/": ("localhost",) * 3}
    got = {r["page_id"]: r for r in named(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)).collect()}
    for i, (host, domain, suffix) in enumerate(urls.values()):
        assert (got[i]["host"], got[i]["domain"], got[i]["suffix"]) == (host, domain, suffix)


def test_good_hosts_stay_and_few_labels_shrink(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for host, rate, n in (("good.site.com", 0.95, 300), ("bad.site.com", 0.05, 300), ("new.site.com", 1.0, 1), ("fine.other.org", 0.9, 300), ("poor.other.org", 0.2, 300)):
        for _ in range(n):
            labels.append((len(rows), int(rng.random() < rate), 0))
            rows.append((len(rows), f"http://{host}/{n}", ""))
    out = url_filter(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS))
    by = {r["host"]: r for r in out.dropDuplicates(["host"]).collect()}
    assert by["good.site.com"]["keep"] and by["fine.other.org"]["keep"] and not by["bad.site.com"]["keep"] and not by["poor.other.org"]["keep"]
    assert by["new.site.com"]["bound"] < by["good.site.com"]["bound"]
    assert out.count() == len(rows)


def test_cases(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.com", ""), (1, "http://a.com", ""), (2, "x" * 100000, "")], PAGES).withColumns({c: F.lit(1) for c in ("host", "domain", "suffix", "n", "good", "alpha", "bound", "keep")})
    none = spark.createDataFrame([], LABELS)
    out = url_filter(pages, none).collect()
    assert len(out) == 4 and all(r["n_labelled"] == 0 for r in out)
    odd = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 0), (2, None, 0)], LABELS)
    assert {(r["host"], r["n_labelled"], r["n_good"]) for r in url_filter(pages, odd).collect()} == {("", 0, 0), ("a.com", 4, 2)}
    assert url_filter(pages.limit(0), none).count() == 0


def test_suffix_files(spark, tmp_path):
    (tmp_path / "suffixes.dat").write_text("// a comment\n\ncom\nco.uk\nsch.co.uk  rest\n*.ck\n!www.ck\n")
    rules = read_suffixes(spark, str(tmp_path / "suffixes.dat"))
    assert rules == Suffixes(frozenset({"co.uk", "sch.co.uk"}), frozenset({"ck"}), frozenset({"www.ck"}))
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "a.b.sch.co.uk": ("b.sch.co.uk", "sch.co.uk"), "sch.co.uk": ("sch.co.uk", "sch.co.uk"), "x.y.z.ck": ("y.z.ck", "z.ck"), "a.www.ck": ("www.ck", "ck"), "ck": ("ck", "ck"), "b.org": ("b.org", "org")}
    got = {r["host"]: (r["domain"], r["suffix"]) for r in named(spark.createDataFrame([(i, f"http://{h}/", "") for i, h in enumerate(want)], PAGES), rules).collect()}
    assert got == want
    out = url_filter(spark.createDataFrame([(1, "http://a.b.sch.co.uk/", "")], PAGES), spark.createDataFrame([(1, 1, 0)], LABELS), suffix_file=str(tmp_path / "suffixes.dat")).first()
    assert out["suffix"] == "sch.co.uk" and out["n_good"] == 1
    assert all(n.count(".") == 1 and "example" not in n for n in DEFAULT.names) and not DEFAULT.wild


def test_clashing_columns_of_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com", ""), (2, "http://b.com", "")], PAGES)
    labels = spark.createDataFrame([(1, 1, 0)], LABELS).withColumns({c: F.lit(7) for c in ("page_id", "good", "n", "host", "suffix", "domain", "url", "bound")})
    assert {(r["page_id"], r["n_labelled"]) for r in url_filter(pages, labels).collect()} == {(1, 1), (2, 0)}
