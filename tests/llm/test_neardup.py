"""Trie self-join against all pairs; groups against brute-force components."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quirework.llm import neardup
from quirework.llm.neardup import BITS, BUDGET, DENSE_GROUP, MAX_BITS, TABLES, drop_near_duplicates, fingerprints, near_duplicates, near_pairs, trie_pairs


def test_trie_pairs_are_all_pairs():
    rng = np.random.default_rng(3)
    for bits, budget in ((8, 2), (16, 4), (48, 4)):
        base = rng.integers(0, 1 << bits, 20)
        value = np.concatenate([base, base ^ (1 << rng.integers(0, bits, 20)), rng.integers(0, 1 << bits, 300), np.repeat(base[:1], 40)])
        group = rng.integers(0, 3, len(value))
        order = np.lexsort((value, group))
        value, group = value[order], group[order]
        got = {(min(a, b), max(a, b)) for i, j in trie_pairs(group, value, bits, budget) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(i, j) for i in range(len(value)) for j in range(i + 1, len(value)) if group[i] == group[j] and int(value[i] ^ value[j]).bit_count() <= budget}
        assert got == want


def brute_groups(rows):
    ids, texts = zip(*rows, strict=True)
    prints, count = fingerprints(pa.array(texts, pa.string()))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if count[a] and count[b]:
                bits = [int(prints[a, t] ^ prints[b, t]).bit_count() for t in range(TABLES)]
                if min(bits) <= BUDGET and sum(bits) <= MAX_BITS:
                    x, y = sorted((find(ids[a]), find(ids[b])))
                    root[y] = x
    return {i: find(i) for i in ids if find(i) != i}


def corpus(seed=4, families=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(w if rng.random() > 0.03 else word() for w in base))
    return list(enumerate(texts))


def test_groups_match_brute_force_for_every_agreement(docs):
    rows = corpus()
    want = brute_groups(rows)
    assert len(want) > 10
    for agree in (0, 1, 3, 5):
        assert {r["doc_id_b"]: r["doc_id_a"] for r in near_duplicates(docs(rows), agree).collect()} == want


def test_recall_of_lightly_edited_copies(docs):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(100)]
        edited = [w if rng.random() > 0.05 else "changed" + w for w in base]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in near_duplicates(docs(rows)).collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(60)} and len(got) >= 54


def test_cases(docs):
    text = "the quick brown fox jumps over the lazy dog by the river bank"
    rows = [(5, text), (3, text.upper()), (9, text + "!"), (3, text), (None, text), (1, None), (2, ""), (4, " .. "), (7, "quite another text about ships and harbours in winter")]
    got = sorted((r["doc_id_a"], r["doc_id_b"], r["bits"]) for r in near_duplicates(docs(rows)).collect())
    assert got == [(3, 5, 0), (3, 9, 0)]
    kept = drop_near_duplicates(docs(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, [3, 3, None, 1, 2, 4, 7]))


def test_thousands_of_copies_extra_columns_and_empty_table(docs):
    df = docs([(i, "one and the same text again and again here") for i in range(3000)]).withColumns({c: F.lit(0) for c in ("id", "root", "s0", "a", "qw_gone")})
    out = drop_near_duplicates(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [0]
    assert near_duplicates(docs([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(501, 500)], "a long, b long")
    got = {r["id"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
    assert BITS == 48


def test_recall_of_the_declared_threshold(docs):
    """Of all pairs within MAX_BITS over whole fingerprints, nine tenths or more are found in each band of word Jaccard."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    rows, band = [], {}
    for k in range(240):
        band[2 * k] = (0.70, 0.75, 0.80, 0.85)[k % 4]
        base = [word() for _ in range(200)]
        shared = round(200 * 2 * band[2 * k] / (1 + band[2 * k]))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:shared] + [word() for _ in range(200 - shared)]))]
    prints, _ = fingerprints(pa.array([t for _, t in rows]))
    near = {i for i in band if sum(int(prints[i, t] ^ prints[i + 1, t]).bit_count() for t in range(TABLES)) <= MAX_BITS}
    for agree in (0, 4, 5):
        got = {r["doc_id_a"] for r in near_duplicates(docs(rows), agree).collect() if r["doc_id_b"] == r["doc_id_a"] + 1}
        assert got <= near
        for b in set(band.values()):
            want = {i for i in near if band[i] == b}
            assert len(want) >= 20 and len(got & want) >= (0.9 if agree else 1) * len(want), (agree, b, len(got & want), len(want))


def test_keys_and_packing(spark):
    assert neardup.PICKED == neardup.picked_runs(neardup.AGREE)
    rng = np.random.default_rng(9)
    sig = [rng.integers(0, 1 << BITS, 50) for _ in range(TABLES)]
    df = spark.createDataFrame([tuple(int(s[i]) for s in sig) for i in range(50)], ", ".join(f"{c} long" for c in neardup.SIGS))
    w = [np.array(x, np.int64) for x in zip(*df.select(*neardup.packed()).collect(), strict=True)]
    w[4] |= np.int64(77) << np.int64(32)
    back, key = neardup.unpacked(w)
    assert all((a == b).all() for a, b in zip(back, sig, strict=True)) and (key == 77).all()


def test_clashing_ids_lose_no_text(docs):
    a, b = "the quick brown fox jumps over the lazy dog by the river bank", "seven ships sailed at dawn to find the winter harbour of the north"
    rows = [(5, a), (5, b), (9, a), (1, b), (9, "something else entirely that nobody has written before now")]
    assert sorted((r["doc_id"], r["text"]) for r in drop_near_duplicates(docs(rows)).collect()) == sorted([(5, a), (1, b), rows[4]])
    assert sorted(tuple(r) for r in near_duplicates(docs(rows)).collect()) == [(1, 5, 0), (5, 9, 0)]
    none = [(2, a), (2, a + " again"), (2, None)]
    assert drop_near_duplicates(docs(none)).count() == 3 and near_duplicates(docs(none)).count() == 0


def components_of(n, a, b):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = sorted((find(x), find(y)))
        label[y] = x
    return [find(x) for x in range(n)]


def flipped(rng, base, n, bits):
    """``n`` copies of a fingerprint with up to ``bits`` of its bits flipped."""
    sig = [np.repeat(s, n) for s in base]
    for i in range(n):
        for bit in rng.choice(TABLES * BITS, rng.integers(0, bits + 1), replace=False):
            sig[bit // BITS][i] ^= np.int64(1) << np.int64(bit % BITS)
    return sig


def test_dense_clusters_keep_their_components():
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 1 << BITS, TABLES) for _ in range(3)]
    bases.append(np.array([s[0] for s in flipped(rng, bases[0], 1, 80)]))
    parts = [flipped(rng, b, n, bits) for b, n, bits in zip(bases, (1800, 900, 300, 300), (20, 45, 60, 30), strict=True)]
    parts.append([rng.integers(0, 1 << BITS, 700) for _ in range(TABLES)])
    sig = [np.concatenate([p[t] for p in parts]) for t in range(TABLES)]
    n = len(sig[0])
    assert n > DENSE_GROUP
    order = np.argsort(sig[0], kind="stable")
    sig = [s[order] for s in sig]
    got = components_of(n, *near_pairs(np.arange(n), np.zeros(n, np.int64), sig[0], sig))
    i, j = np.triu_indices(n, 1)
    own = np.bitwise_count(sig[0][i] ^ sig[0][j]) <= BUDGET
    far = sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in sig)
    least = components_of(n, *((x[own & (far <= MAX_BITS)]) for x in (i, j)))
    most = components_of(n, *((x[far <= MAX_BITS]) for x in (i, j)))
    # every pair within the budget is linked, and nothing that isn't near
    assert all(got[x] == got[least[x]] for x in range(n)) and all(most[x] == most[got[x]] for x in range(n))


def test_a_huge_group_of_near_copies_takes_linear_work():
    rng = np.random.default_rng(6)
    n = 200_000
    sig = []
    for s in rng.integers(0, 1 << BITS, TABLES):
        flips = np.zeros(n, np.int64)
        for _ in range(4):
            flips ^= np.where(rng.random(n) < 0.5, np.int64(1) << rng.integers(0, BITS, n), 0)
        sig.append(s ^ flips)
    order = np.argsort(sig[0], kind="stable")
    sig = [s[order] for s in sig]
    import time

    began = time.process_time()
    a, b = near_pairs(np.arange(n), np.zeros(n, np.int64), sig[0], sig)
    assert len(a) == n - 1 and (b == 0).all() and time.process_time() - began < 60


def keyless_pairs():
    """Rows of text pairs within MAX_BITS that agree on none of the keys of the search by keys."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    texts = []
    for _ in range(1500):
        base = [word() for _ in range(120)]
        texts += [" ".join(base), " ".join(base[:98] + [word() for _ in range(22)])]
    prints, _ = fingerprints(pa.array(texts))
    unlike = prints[::2] ^ prints[1::2]
    far = np.bitwise_count(unlike).sum(1)
    met = np.zeros(len(unlike), bool)
    for runs in neardup.PICKED:
        mask = sum((1 << neardup.RUN) - 1 << run * neardup.RUN for run in runs)
        met |= (unlike & mask == 0).any(1)
    return [(i, texts[i]) for k in np.flatnonzero(~met & (far <= MAX_BITS)).tolist() for i in (2 * k, 2 * k + 1)]


def test_pairs_that_agree_on_no_key_are_found(docs):
    rows = keyless_pairs()
    assert len(rows) >= 6
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in near_duplicates(docs(rows)).collect()}
    assert got == {(i, i + 1) for i, _ in rows[::2]}
    assert [r["doc_id"] for r in drop_near_duplicates(docs(rows)).orderBy("doc_id").collect()] == [i for i, _ in rows[::2]]


def test_parts_let_every_near_pair_through():
    rng = np.random.default_rng(2)
    for cut in neardup.PARTS:
        parts = neardup.parts(cut)
        assert sum(e for _, _, e, _, _ in parts) == MAX_BITS + 1 and all(w <= 16 and w <= length <= 64 for _, w, _, length, _ in parts)
        assert [b for f, w, *_ in parts for b in range(f, f + w)] == list(range(TABLES * BITS))
        for _ in range(500):
            unlike = np.zeros(TABLES * BITS, int)
            unlike[rng.choice(rng.permutation(TABLES * BITS)[: rng.integers(MAX_BITS, TABLES * BITS + 1)], MAX_BITS, replace=False)] = 1
            around = np.tile(unlike, 2)
            assert any(around[f : f + w].sum() < e and around[f : f + length].sum() < most for f, w, e, length, most in parts)


def some_words(rng, n):
    """Random fingerprints as five words, half of them others with 40 to 75 bits flipped."""
    bits = rng.random((n, TABLES * BITS)) < 0.5
    for i in range(n // 2, n):
        bits[i] = bits[i - n // 2]
        bits[i, rng.choice(TABLES * BITS, rng.integers(40, 76), replace=False)] ^= True
    whole = np.zeros((n, 320), bool)
    whole[:, : TABLES * BITS] = bits
    return list(np.packbits(whole, axis=1, bitorder="little").view(np.uint64).T.copy())


def test_close_pairs_are_all_pairs():
    n = 1000
    words = some_words(np.random.default_rng(8), n)
    far = sum(np.bitwise_count(w[:, None] ^ w[None]).astype(np.int64) for w in words)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= MAX_BITS), strict=True) if i < j}
    assert any(far[p] == MAX_BITS for p in want) and (far == MAX_BITS + 1).any() and 200 < len(want) < 500
    every, odd = np.arange(n), np.random.default_rng(9).random(n) < 0.4
    for cut in (*neardup.PARTS, None):
        for a, b in ((every, None), (every[odd], every[~odd])):
            got = {(min(x), max(x)) for piece in range(3) for i, j in neardup.close_pairs(words, a, b, piece, 3, cut) for x in zip(i.tolist(), j.tolist(), strict=True)}
            assert got == {p for p in want if b is None or odd[p[0]] != odd[p[1]]}


def test_cells_of_dense_clusters_keep_their_components(monkeypatch):
    monkeypatch.setattr(neardup, "CLUSTER", 64)
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 1 << BITS, TABLES) for _ in range(3)]
    bases.append(np.array([s[0] for s in flipped(rng, bases[0], 1, 80)]))
    parts = [flipped(rng, b, n, bits) for b, n, bits in zip(bases, (1800, 900, 300, 300), (20, 45, 60, 30), strict=True)]
    bits = np.concatenate([np.stack([np.concatenate([p[t] for p in parts]) for t in range(TABLES)], 1)])
    flat = (bits[:, :, None] >> np.arange(BITS) & 1).reshape(len(bits), -1).astype(bool)
    flat = np.unique(flat, axis=0)
    n = len(flat)
    whole = np.zeros((n, 320), bool)
    whole[:, : TABLES * BITS] = flat
    words = list(np.packbits(whole, axis=1, bitorder="little").view(np.uint64).T.copy())
    assert n > DENSE_GROUP
    i, j = np.triu_indices(n, 1)
    near = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words) <= MAX_BITS
    want = components_of(n, i[near], j[near])
    block = rng.random(n) < 0.5
    found = [neardup.cell_edges(np.arange(n), words, np.zeros(n, bool), piece, 2) for piece in range(2)]
    assert components_of(n, *(np.concatenate(x) for x in zip(*found, strict=True))) == want
    cells = [(block, np.zeros(n, bool)), (~block, np.zeros(n, bool)), (np.ones(n, bool), block)]
    found = []
    for rows, second in cells:
        ids = np.flatnonzero(rows)
        found += [neardup.cell_edges(ids, [w[ids] for w in words], second[ids], piece, 2) for piece in range(2)]
    assert components_of(n, *(np.concatenate(x) for x in zip(*found, strict=True))) == want


def test_blocks_and_pieces_give_the_same_groups(spark, monkeypatch):
    n = 2100
    words = some_words(np.random.default_rng(10), n)
    whole = np.unpackbits(np.stack(words, 1).view(np.uint8), axis=1, bitorder="little")[:, : TABLES * BITS]
    sig = whole.reshape(n, TABLES, BITS).astype(np.int64) @ (np.int64(1) << np.arange(BITS))
    i, j = np.triu_indices(n, 1)
    near = np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64) <= MAX_BITS
    want = components_of(n, i[near], j[near])
    prints = spark.createDataFrame([(k, *row) for k, row in enumerate(sig.tolist())], ", ".join(f"{c} long" for c in ["node", *neardup.SIGS])).repartition(5)
    for block in (n, 1100, 500):
        monkeypatch.setattr(neardup, "BLOCK", block)
        edges = [(r["a"], r["b"]) for r in neardup._search(prints, 0).collect()]
        assert components_of(n, *(np.array(x) for x in zip(*edges, strict=True))) == want
