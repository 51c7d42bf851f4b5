"""Both packers: exact round trips, brute-force placement, segment tree against a scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import tokens
from quirework.llm.packing import FreeSpace, Piece, best_fit_decreasing, pack, pieces_of, unpack, write_matrices
from quirework.llm.windows import Window, pack_windows, place

TEXTS = ["short one", "", None, "word " * 9000, "été \U0001f600 سلام", "tie tie", "tie tie", " \n\n "]


def brute_bfd(sizes, width):
    free, where = [], []
    for s in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            k = max(i for i, f in enumerate(free) if f == min(fits))
            free[k] -= s
        else:
            k = len(free)
            free.append(width - s)
        where.append(k)
    return sorted(free)


def test_segment_tree_finds_what_a_scan_finds():
    rng = random.Random(0)
    space, held = FreeSpace(50), []
    for n in range(3000):
        if rng.random() < 0.5 or not held:
            free = rng.randint(0, 50)
            space.put(free, n)
            held.append(free)
        else:
            least = rng.randint(1, 50)
            fits = [f for f in held if f >= least]
            got = space.take(least)
            assert (got is None) == (not fits)
            if fits:
                held.remove(min(fits))
                space.put(0, got)
                held.append(0)


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 80))]
        got = best_fit_decreasing([Piece(i, 0, np.zeros(s, "<u2")) for i, s in enumerate(sizes)], 40)
        assert sorted(w.free for w in got) == brute_bfd(sizes, 40)


@pytest.mark.parametrize("width", [16, 4096])
def test_matrix_round_trip(docs, width):
    out = pack(docs(TEXTS), width).cache()
    size = tokens.id_type(tokens.TOKENIZER).itemsize
    for r in out.collect():
        assert len(r["ids"]) == width * size and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_ids"] and r["position_resets"] == r["cu_seqlens"][:-1]
    assert {r["doc_id"]: r["text"] for r in unpack(out).collect()} == {i: t for i, t in enumerate(TEXTS) if t}


def test_whole_table_round_trip(documents):
    have = {r["doc_id"]: r["text"] for r in documents.where("text <> ''").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["text"] for r in unpack(pack(documents)).collect()} == have
    assert {r["doc_id"]: r["text"] for r in unpack(pack_windows(documents)).collect()} == have


def test_files_hold_the_rows(docs, tmp_path):
    out = pack(docs(TEXTS), 32).cache()
    rows = out.count()
    manifest = write_matrices(out, str(tmp_path / "m")).collect()
    assert sum(m["rows"] for m in manifest) == rows
    size = tokens.id_type(tokens.TOKENIZER).itemsize
    assert sum(len(open(m["ids_file"], "rb").read()) for m in manifest) == rows * 32 * size
    for m in manifest:
        flat = np.fromfile(m["cu_file"], "<i4")
        at = n = 0
        while at < len(flat):
            at, n = at + 1 + flat[at], n + 1
        assert n == m["rows"]


def brute_place(sizes, width, most):
    """Free space of emitted windows in order, then of those left open."""
    open_, out = [], []
    for s in sizes:
        fits = [w for w in open_ if w[0] >= s]
        if fits:
            min(fits, key=lambda w: w[0])[0] -= s
            continue
        if len(open_) == most:
            full = min(open_, key=lambda w: w[0])
            open_ = [w for w in open_ if w is not full]
            out.append(full[0])
        open_.append([width - s])
    return out, [w[0] for w in open_]


def test_online_placement_equals_brute_force():
    rng = random.Random(6)
    for _ in range(20):
        sizes, open_, out = [rng.randint(1, 30) for _ in range(200)], [], []
        for k, s in enumerate(sizes):
            done = place(open_, Piece(k, 0, np.zeros(s, "<u2")), 30, 4)
            out += [done.free] if done else []
        assert (out, [w.free for w in open_]) == brute_place(sizes, 30, 4)
    assert Window(3).free == 3 and [p.start for p in pieces_of(1, np.zeros(7), 3)] == [0, 3, 6]


def test_windows_keep_every_id_and_merge_left_overs(docs):
    texts = [f"text number {k} " * (k % 9) for k in range(200)] + TEXTS
    out = pack_windows(docs(texts).repartition(4), 64, 4).collect()
    ids = {}
    for r in out:
        assert r["n_ids"] <= 64
        flat = np.frombuffer(r["ids"], tokens.id_type(tokens.TOKENIZER))
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            ids.setdefault(d, {})[s] = flat[a:b]
    for i, t in enumerate(texts):
        if t:
            assert np.array_equal(np.concatenate([ids[i][s] for s in sorted(ids[i])]), tokens.encode(t, tokens.TOKENIZER))
    assert sum(r["n_ids"] for r in out) > 0.9 * 64 * (len(out) - 1)


def test_extra_columns_null_ids_repeats_and_empty_table(docs):
    df = docs([(None, "no id"), (1, "same"), (1, "same")]).withColumns({c: F.lit(1) for c in ("ids", "n_ids", "task", "left_over", "bundle")})
    for f in (pack, pack_windows):
        assert sorted(str(d) for r in f(df).collect() for d in r["doc_ids"]) == ["1", "1", "None"]
        assert f(docs([])).count() == 0
        with pytest.raises(ValueError):
            f(df, 0)
