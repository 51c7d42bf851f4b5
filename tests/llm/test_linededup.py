"""Line dedup against brute force over all windows, and its defined cases."""

import random

from pyspark.sql import functions as F

from quirework.llm.linededup import _lines, _ranked, dedup_lines


def brute(rows, min_lines=3, min_words=50, least_words=5):
    """Every window of 1 to ``min_lines`` lines, or of a larger power of two, that counts and was seen before goes."""
    words = lambda s: s.count(" ") + 1 if s.strip(" ") else 0
    docs, seen, gone = {(-(1 << 63) if i is None else i): t.split("\n") for i, t in rows if t is not None}, set(), {}
    for i in sorted(docs):
        lines = docs[i]
        for p in range(len(lines)):
            for h in sorted({*range(1, min_lines + 1), *(1 << k for k in range(len(lines).bit_length()))}):
                if p + h > len(lines):
                    break
                total = sum(map(words, lines[p : p + h]))
                if total >= min_words or h >= min_lines and total >= min(min_words, least_words):
                    key = tuple(lines[p : p + h])
                    if key in seen:
                        gone.setdefault(i, set()).update(range(p, p + h))
                    seen.add(key)
    return {i: "\n".join(x for k, x in enumerate(lines) if k not in gone.get(i, ())) for i, lines in docs.items()}


def kept(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_random_runs_match_brute_force(docs):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 3, 60]))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    want = {i: t for i, t in brute(rows).items() if t.strip()}
    had = dict(rows)
    got = kept(dedup_lines(docs(rows)))
    assert got == {i: t for i, t in want.items()} | {i: t for i, t in had.items() if not t.strip() and i in got}


def test_cases(docs):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(None, "x " + passage), (1, None), (2, ""), (3, passage), (3, passage), (4, f"own\n{passage}"), (5, f"{passage}\n{passage}\nend"), (6, "short line"), (7, "short line")]
    got = sorted(dedup_lines(docs(rows)).select("doc_id", "text", "n_chars").collect(), key=str)
    by = [(r["doc_id"], r["text"]) for r in got]
    assert (1, None) in by and (2, "") in by and (None, "x " + passage) in by
    assert by.count((3, passage)) == 2  # repeated rows are one document
    assert (4, "own") in by and (5, "end") in by and (6, "short line") in by and (7, "short line") in by
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)


def test_all_copies_but_the_first_go(docs):
    text = "\n".join(f"line number {k} of the copy" for k in range(5))
    assert kept(dedup_lines(docs([(i, text) for i in range(30)]))) == {0: text}


def test_extra_columns_empty_table_and_long_text(docs):
    long = "\n".join(f"row {k % 7} says something plain" for k in range(20000))
    df = docs([(0, long), (1, "a")]).withColumns({c: F.lit(c) for c in ("did", "key", "pos", "gone", "rank", "words", "lines", "need", "qw_did")})
    out = dedup_lines(df)
    assert out.columns == df.columns and out.where("doc_id = 0").first()["text"].count("\n") < 10 and out.first()["rank"] == "rank"
    assert dedup_lines(docs([])).count() == 0


def whole_runs(rows, min_lines=3, min_words=50):
    """Without every maximal run that an earlier line starts too, looked for line by line; lines have five words or more."""
    at = [(i, p) for i, t in rows for p in range(t.count("\n") + 1)]
    lines, gone = {i: t.split("\n") for i, t in rows}, set()
    for k, (i, p) in enumerate(at):
        longest = 0
        for j, q in at[:k]:
            h = 0
            while p + h < len(lines[i]) and q + h < len(lines[j]) and lines[i][p + h] == lines[j][q + h]:
                h += 1
            longest = max(longest, h)
        run = lines[i][p : p + longest]
        if longest >= min_lines or sum(len(x.split(" ")) for x in run) >= min_words:
            gone.update((i, p + h) for h in range(longest))
    return {i: "\n".join(x for p, x in enumerate(x) if (i, p) not in gone) for i, x in lines.items()}


def test_whole_maximal_runs_go(docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 60), ("b", 10), ("c", 10)))
    rows = [(0, f"{a}\n{b}\n{c}\nfirst end"), (1, f"one begin\n{a}\n{b}\n{c}\none end"), (2, f"two begin\n{a}\n{b}\ntwo end")]
    assert kept(dedup_lines(docs(rows))) == {0: rows[0][1], 1: "one begin\none end", 2: "two begin\ntwo end"} == whole_runs(rows)
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 6, 20, 60]))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    for min_lines in (1, 3, 4, 6):
        assert kept(dedup_lines(docs(rows), min_lines)) == {i: t for i, t in whole_runs(rows, min_lines).items() if t}


def test_runs_of_hundreds_of_lines(docs):
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(6))
    runs = [[line() for _ in range(n)] for n in (300, 517, 64, 65)]
    rows = []
    for i in range(12):
        a, b = rng.choice(runs), rng.choice(runs)
        cut = rng.randint(0, len(a) - 3)
        rows.append((i, "\n".join([line(), *a[cut:], line(), *b[: rng.randint(3, len(b))], line()])))
    want = {i: t for i, t in whole_runs(rows).items() if t}
    assert kept(dedup_lines(docs(rows))) == want == {i: t for i, t in brute(rows).items() if t}


def test_ranks_are_places_in_the_suffix_array(docs):
    """Ranks by h lines order the repeated suffixes as their line IDs do, and equal ranks are equal prefixes."""
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(12))) for i in range(6)]
    lines = _lines(docs(rows))
    ids = {(r["did"], r["pos"]): (r["by1"], r["by2"]) for r in lines.collect()}
    text = lambda d, p, h: tuple(ids[d, p + k] for k in range(h))
    one = {(r["did"], r["pos"]): r["rank"] for r in _ranked(lines).collect()}
    assert sorted(one, key=one.get) and all((one[x] < one[y]) == (text(*x, 1) < text(*y, 1)) and (one[x] == one[y]) == (text(*x, 1) == text(*y, 1)) for x in one for y in one)
