"""SimHash near-dedup by an exact Hamming self-join.

Each document gets a fingerprint of ``TABLES`` independent SimHashes of ``BITS`` bits over its distinct
normalised words.  Two documents are near duplicates if their whole fingerprints differ in at most
``MAX_BITS`` of ``TABLES * BITS`` bits, which is an angle of about 0.63 between the word sets (four
fifths shared).

``_all_pairs`` finds every such pair.  Fingerprints are dealt into blocks, and each pair of blocks is a cell
that tasks compare.  There the bits are cut into parts with budgets that add up to ``MAX_BITS + 1``: a pair
not under budget in any part differs in more than ``MAX_BITS`` bits, so a near one is under it in some part.
What is more, the parts form a ring, and from one of them on every run of parts is under the run's budget
(or runs over it would follow one another around the ring and add up to more than ``MAX_BITS``).  A part's
values are few; each is compared with the rows of the values under budget only (with twenty parts an eighth of all
pairs at random), and in one word that holds the parts that follow.  Work grows as the square of the
distinct fingerprints.

With ``agree`` above 0, candidates agree on a key of ``agree`` runs of ``RUN`` bits of one table instead.
Rows are shuffled and sorted by key, and in each group that table's hashes form a binary trie that is joined
with itself: pairs of nodes go down together, a pair of unlike children costs one bit, and a pair over
``BUDGET`` is dropped with everything below it.  A pair just at the threshold meets under one of the ``KEYS``
keys with a probability of 0.98 and is lost otherwise, so no query uses this.

Documents with equal fingerprints are one node, so thousands of copies cost as much as two, and large clusters
of near copies are linked to a centre (``thinned``) and not pair by pair.  Groups of near
duplicates are the connected components of the pairs.  A task reports a spanning forest of its pairs, not
all of them, so a group of a million near copies gives a million edges and not a trillion.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import checkpoint, fresh
from .textbatch import hash_words, mix64, normal_words, plain, slices

TABLES, BITS, BUDGET = 6, 48, 12
MAX_BITS = 60
#: Bits of a run, and keys in each table by the number of runs in a key.
RUN, KEYS = 2, (1, 2, 3, 4, 5, 7)
#: Runs in a key of the search by keys, which may lose pairs; 0 is the exact search.
AGREE = 5
#: What ``runs_of_bits`` picks for ``AGREE``, as it takes a while.
PICKED = ((0, 1, 2, 3, 4), (5, 6, 7, 8, 9), (10, 11, 12, 13, 14), (15, 16, 17, 18, 19), (0, 20, 21, 22, 23), (1, 5, 10, 15, 20), (2, 6, 11, 16, 21))
#: Groups of more rows are searched for dense clusters first.
DENSE_GROUP = 1 << 11
#: Rows that a task holds before it compares the groups it has.
HELD = 1 << 17
#: Pairs of trie nodes with at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 1 << 16
#: Of those, pairs of nodes with more leaf pairs than this are compared as one dense block each.
DENSE = 1 << 9
FRONTIER = 1 << 18
#: Fingerprints in a block of the exact search, at most, and tasks that it makes of few cells.
BLOCK, TASKS = 1 << 19, 24
#: Numbers of parts to choose from.
PARTS = (36, 28, 24, 20, 18)
#: Rows of one value that are compared at a time, and pairs in a tile of them.
ITEM, TILE = 1 << 6, 1 << 17
#: Clusters of so many near copies are linked to a centre before a cell is compared.
CLUSTER = 1 << 11


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, TABLES) of 48-bit SimHashes, and the number of distinct words of each row."""
    words = normal_words(texts)
    n = len(texts)
    if not len(words.codes):
        return np.zeros((n, TABLES), np.int64), np.zeros(n, np.int64)
    kinds = len(words.dictionary)
    key = np.unique(words.doc * kinds + words.codes)
    doc, code = key // kinds, key % kinds
    count = np.bincount(doc, minlength=n)
    h = hash_words(words.dictionary)
    width = BITS // 8
    packed = np.empty((kinds, TABLES * width), np.uint8)
    for t in range(TABLES):
        packed[:, t * width : (t + 1) * width] = mix64(h + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)[:, :width]
    lanes = np.unpackbits(packed, axis=1, bitorder="little").view(np.uint64)  # a byte for each bit, eight to a number
    # sections of at most 255 words of one document: no byte overflows
    parts = -(-count // 255)
    owner = np.repeat(np.arange(n), parts)
    edges = np.append((np.cumsum(count) - count)[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)), len(code))
    total = np.zeros((n, TABLES * BITS), np.int32)
    s = 0
    while s < len(owner):
        e = max(s + 1, int(np.searchsorted(edges, edges[s] + (1 << 15), side="right")) - 1)
        sums = np.add.reduceat(lanes[code[edges[s] : edges[e]]], edges[s:e] - edges[s], axis=0).view(np.uint8)
        heads = np.flatnonzero(np.diff(owner[s:e], prepend=-1))
        total[owner[s:e][heads]] += np.add.reduceat(sums, heads, axis=0, dtype=np.int32)
        s = e
    half = 2 * total - count[:, None].astype(np.int32)
    on = (half > 0) | (half == 0) & (np.arange(TABLES * BITS) % BITS % 2 == 0)  # a tie sets the even bits
    out = on.reshape(n, TABLES, BITS).astype(np.int64) @ (np.int64(1) << np.arange(BITS, dtype=np.int64))
    out[count == 0] = 0
    return out, count


SIGS = [f"s{t}" for t in range(TABLES)]


def _signed(docs: DataFrame) -> DataFrame:
    """id, key (a hash of the text: rows of one doc_id may differ) and fingerprint of every document that has words."""
    names = ["id", "key", *SIGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 2 << 20):
                prints, count = fingerprints(plain(batch.column(2)))
                some = pa.array(np.flatnonzero(count))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), *[pa.array(prints[some, t]) for t in range(TABLES)]], names)

    schema = "id long, key long, " + ", ".join(f"{c} long" for c in SIGS)
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema)


def trie_pairs(group: np.ndarray, value: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of equal group whose values differ in at most ``budget`` bits.

    (group, value) must be sorted; a trie node is then a range of indexes, its children are found from
    running counts of set bits, and all groups' tries are walked at once, one level a step.
    """
    n = len(value)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    ones = [np.concatenate([[0], np.cumsum(value >> (bits - 1 - d) & 1)]) for d in range(bits)]
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            for k in range(0, len(a0), FRONTIER):
                stack.append((depth, *(x[k : k + FRONTIER] for x in (a0, a1, b0, b1, err))))
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth == bits)
        if small.any():
            yield from _leaves(value, budget, a0[small], a1[small], b0[small], b1[small])
            big = ~small
            a0, a1, b0, b1, err = a0[big], a1[big], b0[big], b1[big], err[big]
        if not len(a0):
            continue
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), tuple(x[~same] for x in (am, a1, b0, bm, err + 1))]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (err <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        stack.append((depth + 1, a0[keep], a1[keep], b0[keep], b1[keep], err[keep]))


def _leaves(value: np.ndarray, budget: int, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    dense = ((a1 - a0) * (b1 - b0) > DENSE) & ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS)
    for x0, x1, y0, y1 in zip(*(x[dense].tolist() for x in (a0, a1, b0, b1)), strict=True):
        i, j = np.nonzero(np.bitwise_count(value[x0:x1, None] ^ value[None, y0:y1]) <= budget)
        i, j = i + x0, j + y0
        yield (i[i < j], j[i < j]) if x0 == y0 else (i, j)
    a0, a1, b0, b1 = a0[~dense], a1[~dense], b0[~dense], b1[~dense]
    width = b1 - b0
    sizes = (a1 - a0) * width
    total = np.cumsum(sizes)
    done = 0
    while done < len(sizes):
        base = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, base + (1 << 22), side="right")))
        part = slice(done, upto)
        if sizes[done] > 1 << 22:  # one pair of huge equal leaves: a row of it at a time
            for i in range(int(a0[done]), int(a1[done])):
                j = np.arange(max(int(b0[done]), i + 1) if a0[done] == b0[done] else int(b0[done]), int(b1[done]))
                near = np.bitwise_count(value[j] ^ value[i]) <= budget
                yield np.full(int(near.sum()), i), j[near]
            done += 1
            continue
        owner = np.repeat(np.arange(done, upto), sizes[part])
        k = np.arange(len(owner)) - np.repeat(total[part] - sizes[part] - base, sizes[part])
        i, j = a0[owner] + k // width[owner], b0[owner] + k % width[owner]
        near = (i != j) & ((i < j) | (a0[owner] != b0[owner])) & (np.bitwise_count(value[i] ^ value[j]) <= budget)
        yield i[near], j[near]
        done = upto


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of every component of the edges a-b, without the smallest itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]


def picked_runs(agree: int) -> tuple[tuple[int, ...], ...]:
    """The keys of a table, each ``agree`` runs; any two of them share few runs."""
    left = list(combinations(range(BITS // RUN), agree))
    keys: list[tuple[int, ...]] = []
    used, together = [0] * (BITS // RUN), Counter()
    while len(keys) < KEYS[agree]:
        best = min(left, key=lambda c: (sum(together[p] for p in combinations(c, 2)), sum(used[i] for i in c), c))
        left.remove(best)
        keys.append(best)
        together.update(combinations(best, 2))
        for i in best:
            used[i] += 1
    return tuple(keys)


def packed() -> list[Column]:
    """w0 to w4: the fingerprint's ``TABLES * BITS`` bits in four and a half numbers."""
    s = [F.col(c) for c in SIGS]
    part = lambda c, low: F.shiftleft(F.shiftright(c, low).bitwiseAND(F.lit(0xFFFF)), 48)
    tails = [part(s[4], 0), part(s[4], 16), part(s[4], 32), part(s[5], 0)]
    return [*[s[k].bitwiseOR(tails[k]).alias(f"w{k}") for k in range(4)], F.shiftright(s[5], 16).alias("w4")]


def unpacked(w: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(fingerprints by table, key) from w0 to w4, the key above the half number."""
    low, tail = [x & (1 << 48) - 1 for x in w[:4]], [x >> 48 & 0xFFFF for x in w[:4]]
    return [*low, tail[0] | tail[1] << 16 | tail[2] << 32, tail[3] | (w[4] & 0xFFFFFFFF) << 16], w[4] >> 32


def _far(sig: list[np.ndarray], i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
    """In how many bits whole fingerprints differ."""
    return sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in sig)


def thinned(own: np.ndarray, sig: list[np.ndarray], at: np.ndarray, least: int = 64, doubts: bool = True) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(what is left of ``at``, edges): dense clusters of a large group without comparing all their pairs.

    The value that most rows share is where a cluster is.  One of those rows is compared with all others; what
    is near it is linked to it and need not be compared again, not even with a row ``b`` that is left: by the
    triangle inequality only rows at least ``d(b) - MAX_BITS`` from the centre can be near ``b``, and these are
    compared here.  So no component is lost, and ``n`` near copies take about ``n`` comparisons.  Clusters have
    ``least`` rows or more; without ``doubts`` the comparisons with what is left are another task's.
    """
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at) > DENSE_GROUP:
        starts = np.flatnonzero(np.diff(own[at], prepend=own[at[0]] - 1))
        runs = np.diff(np.append(starts, len(at)))
        if runs.max() < least // 8:
            break
        centre = at[starts[runs.argmax()]]
        far = _far(sig, at, centre)
        near = far <= MAX_BITS
        members, apart = at[near], far[near]
        if len(members) < least:
            break
        edges.append((members, np.full(len(members), centre)))
        if not doubts:
            at = at[~near]
            continue
        by = np.argsort(apart, kind="stable")
        members, apart = members[by], apart[by]
        for b, d in zip(at[doubt := ~near & (far <= MAX_BITS + apart[-1])].tolist(), far[doubt].tolist(), strict=True):
            some = members[np.searchsorted(apart, d - MAX_BITS) :]
            if len(hit := some[_far(sig, some, b) <= MAX_BITS]):
                edges.append((hit[:1], np.array([b])))
        at = at[~near]
    return at, edges


def near_pairs(ids: np.ndarray, group: np.ndarray, own: np.ndarray, sig: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a spanning forest of the near pairs within groups; (group, own) must be sorted."""
    ea, eb, held = [], [], 0
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(np.append(starts, len(group)))
    keep = np.ones(len(group), bool)
    for k in np.flatnonzero(sizes > DENSE_GROUP).tolist():
        whole = slice(int(starts[k]), int(starts[k] + sizes[k]))
        left, edges = thinned(own, sig, np.arange(whole.start, whole.stop))
        keep[whole] = False
        keep[left] = True
        for x, y in edges:
            ea.append(ids[x])
            eb.append(ids[y])
    ids, group, own, sig = ids[keep], group[keep], own[keep], [s[keep] for s in sig]
    for i, j in trie_pairs(group, own, BITS, BUDGET):
        far = np.zeros(len(i), np.int64)
        for s in sig:
            far += np.bitwise_count(s[i] ^ s[j])
            near = far <= MAX_BITS
            i, j, far = i[near], j[near], far[near]
        ea.append(ids[i])
        eb.append(ids[j])
        held += len(i)
        if held > 1 << 20:
            a, b = _forest(np.concatenate(ea), np.concatenate(eb))
            ea, eb, held = [a], [b], len(a)
    return _forest(np.concatenate(ea), np.concatenate(eb)) if ea else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@cache
def parts(cut: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """(first bit, width, budget, width of the run, budget of the run) of ``cut`` parts of a fingerprint.

    A near pair differs in fewer bits than the budget in one part at least, and in the run of parts that starts
    there and fills one word.  Budgets add up to ``MAX_BITS + 1``, each bit spent where it lets the fewest random
    pairs through.
    """
    edges = [TABLES * BITS * k // cut for k in range(cut + 1)]
    widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    budgets = [0] * cut
    for _ in range(MAX_BITS + 1):
        budgets[min(range(cut), key=lambda p: (comb(widths[p], budgets[p]) / 2 ** widths[p], p))] += 1
    out = []
    for p in range(cut):
        run = [p]
        while sum(widths[q] for q in run) + widths[(run[-1] + 1) % cut] <= 64:
            run.append((run[-1] + 1) % cut)
        out.append((edges[p], widths[p], budgets[p], sum(widths[q] for q in run), sum(budgets[q] for q in run)))
    return tuple(out)


def best_cut(na: int, nb: int) -> int:
    """The number of parts that takes least time for ``na`` times ``nb`` rows; the result is the same with all."""

    def seconds(cut: int) -> float:
        share = sum(sum(comb(w, k) for k in range(e)) / 2**w for _, w, e, _, _ in parts(cut))
        return 1.5e-9 * na * nb * share + 3e-5 * sum(min(1 << w, na) for _, w, *_ in parts(cut))

    return min(PARTS, key=seconds)


def _ring(words: list[np.ndarray]) -> list[np.ndarray]:
    """The 288 bits and, after them, the first 96 again."""
    half = np.uint64(32)
    return [*words[:4], words[4] | words[0] << half, words[0] >> half | words[1] << half]


def _field(ring: list[np.ndarray], first: int, width: int) -> np.ndarray:
    """``width`` (64 at most) of the bits from ``first`` on."""
    k, low = divmod(first, 64)
    value = ring[k] >> np.uint64(low)
    if low + width > 64:
        value = value | ring[k + 1] << np.uint64(64 - low)
    return value & np.uint64((1 << width) - 1)


def close_pairs(words: list[np.ndarray], a: np.ndarray, b: np.ndarray | None, piece: int = 0, pieces: int = 1, cut: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs from ``a`` and ``b`` (or both from ``a``) whose 288 bits differ in at most ``MAX_BITS``; some come twice.

    ``piece`` does its share of the work only; all ``pieces`` together find all pairs.
    """
    cut = best_cut(len(a), len(a if b is None else b)) if cut is None else cut
    ring = _ring(words)
    xor, count, near = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def judged() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        some = (i != j) & (_far(words, i, j) <= MAX_BITS)
        return i[some], j[some]

    waiting = 0
    for p, (first, width, budget, length, most) in enumerate(parts(cut)):
        value = _field(ring, first, width).astype(np.uint16)
        run = _field(ring, first, length)
        rows = a[np.argsort(value[a], kind="stable")]
        others = rows if b is None else b[np.argsort(value[b], kind="stable")]
        left, right = run[rows], run[others]
        own = value[rows].astype(np.int64)
        edge = np.searchsorted(value[others], np.arange((1 << width) + 1))
        masks = np.flatnonzero(np.bitwise_count(np.arange(1 << width)) < budget)
        # items: up to ITEM rows of one value
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        sizes = np.diff(np.append(heads, len(own)))
        times = -(-sizes // ITEM)
        starts = np.repeat(heads, times) + ITEM * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        ends = np.minimum(starts + ITEM, np.repeat(heads + sizes, times))
        mine = slice((piece + p) % pieces, None, pieces)
        for s, e in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True):
            value_s = own[s]
            like = masks ^ value_s
            if b is None:
                like = like[like >= value_s]
            low = edge[like]
            size = edge[like + 1] - low
            if b is None:  # the item's own value comes first, without the rows before the item
                size[0] -= s - low[0]
                low[0] = s
            total = int(size.sum())
            if not total:
                continue
            at = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
            column = right[at]
            step = TILE // (e - s)
            for c in range(0, total, step):
                d = min(step, total - c)
                x, n, ok = (buffer[: (e - s) * d].reshape(e - s, d) for buffer in (xor, count, near))
                np.bitwise_xor(left[s:e, None], column[None, c : c + d], out=x)
                np.bitwise_count(x, out=n)
                np.less(n, most, out=ok)
                if len(hit := np.flatnonzero(ok)):
                    held.append((rows[s + hit // d], others[at[c + hit % d]]))
                    waiting += len(hit)
                if waiting > 1 << 18:
                    yield judged()
                    waiting = 0
    if held:
        yield judged()


def cell_edges(ids: np.ndarray, words: list[np.ndarray], second: np.ndarray, piece: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a spanning forest of the near pairs between a cell's two blocks, or within its only one (no row is ``second``)."""
    value = (words[0] & np.uint64((1 << BITS) - 1)).astype(np.int64)
    at, edges = thinned(value, words, np.argsort(value, kind="stable"), CLUSTER, piece == 0)
    ea, eb, held = [ids[x] for x, _ in edges], [ids[y] for _, y in edges], 0
    if second.any():
        a, b = at[~second[at]], at[second[at]]
    else:
        a, b = at, None
    for i, j in close_pairs(words, a, b, piece, pieces) if len(a) and (b is None or len(b)) else ():
        ea.append(ids[i])
        eb.append(ids[j])
        held += len(i)
        if held > 1 << 20:
            x, y = _forest(np.concatenate(ea), np.concatenate(eb))
            ea, eb, held = [x], [y], len(x)
    return _forest(np.concatenate(ea), np.concatenate(eb)) if ea else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _all_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): edges that connect all near duplicates among distinct fingerprints ``node``; a > b."""
    rows = prints.count()
    blocks = max(1, -(-rows // BLOCK))
    cells = blocks * (blocks + 1) // 2
    pieces = max(1, min(TASKS // cells, rows >> 10))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks))
    high, low = F.greatest("block", "other"), F.least("block", "other")
    task = (high * (high + 1) / 2).cast("long") + low
    names = [f"w{k}" for k in range(4)]
    spread = prints.select("node", *packed(), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    spread = spread.select("node", *names, "w4", task.alias("cell"), (F.col("block") > F.col("other")).cast("long").alias("second"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece"))
    key = (F.col("cell") * pieces + F.col("piece")) * 2 + F.col("second")
    spread = spread.select("node", *names, F.col("w4").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftleft(key, 32)).alias("w4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        ids, *words = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        key = words[4] >> 32
        words = [w.view(np.uint64) for w in (*words[:4], words[4] & 0xFFFFFFFF)]
        a, b = cell_edges(ids, words, key % 2 == 1, int(key[0]) // 2 % pieces, pieces)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # a partition is one piece of one cell
    return spread.repartitionById(cells * pieces, F.shiftright("w4", 33).cast("int")).mapInArrow(run, "a long, b long").distinct()


def _search(prints: DataFrame, agree: int) -> DataFrame:
    """(a, b): edges that connect the near duplicates among distinct fingerprints ``node``; a > b."""
    if not agree:
        return _all_pairs(prints)
    choices = PICKED if agree == AGREE else picked_runs(agree)
    keys = []
    for t in range(TABLES):
        for c, runs in enumerate(choices):
            key, at = F.lit(t * len(choices) + c).cast("long"), 8
            for run in runs:
                key = key.bitwiseOR(F.shiftleft(F.shiftright(F.col(SIGS[t]), run * RUN).bitwiseAND(F.lit((1 << RUN) - 1)), at))
                at += RUN
            keys.append(F.shiftleft(key, 32))
    exploded = prints.select("node", *packed(), F.array(*keys).alias("keys")).select("node", *[f"w{k}" for k in range(4)], "w4", F.explode("keys").alias("key")).select("node", *[f"w{k}" for k in range(4)], F.col("w4").bitwiseOR(F.col("key")).alias("w4"))

    def edges(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, *w = (np.concatenate(x) for x in zip(*held, strict=True))
        sig, key = unpacked(w)
        own = np.choose((key & 255) // len(choices), sig)
        order = np.lexsort((own, key))
        a, b = near_pairs(ids[order], key[order], own[order], [s[order] for s in sig])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key: whole groups are compared as soon as enough are there, so memory is bounded by them and one group."""
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rows >= HELD:
                other = columns[-1] >> 32 != held[-1][-1][-1] >> 32
                own = int(other.argmax()) if other.any() else len(other)
                if own:
                    held.append([c[:own] for c in columns])
                    columns = [c[own:] for c in columns]
                if len(columns[-1]):
                    yield from edges(held)
                    held, rows = [], 0
            if len(columns[-1]):
                held.append(columns)
                rows += len(columns[-1])
        if held:
            yield from edges(held)

    key = F.shiftright("w4", 32)
    return exploded.repartition(key).sortWithinPartitions(key).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's component, by alternating large and small stars.

    Every round halves the trees' height at least; edges are joined to per-node minima, never gathered
    into one node's list, so a hub's size doesn't matter.  Rounds are cut by checkpoints.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(now.join(low, "a").select("a", F.col("m").alias("b")))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = checkpoint(small.where("a <> b").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = mark


def groups(docs: DataFrame, agree: int = 0) -> DataFrame:
    """id, key, root, bits: each document with a near duplicate of lower id in its group, the group's lowest id, and in how many bits its fingerprint differs from that document's.

    The graph's nodes are distinct fingerprints, so texts that share a doc_id are judged apart.
    """
    signed = checkpoint(_signed(docs))
    alike = signed.groupBy(*SIGS).agg(F.min("id").alias("head"), F.max("id").alias("last"))
    prints = checkpoint(alike.withColumn("node", F.monotonically_increasing_id()))
    near = components(_search(prints, agree))
    grouped = prints.join(near.withColumnRenamed("id", "node"), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    first = F.min(F.struct("head", *[F.col(c).alias(f"r{c}") for c in SIGS])).alias("first")
    roots = grouped.groupBy("group").agg(first, F.max("last").alias("last")).where(F.col("last") > F.col("first.head"))
    named = grouped.join(roots.select("group", "first"), "group").select(*SIGS, "first.*")
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"r{c}"))) for c in SIGS), F.lit(0))
    return signed.join(named, SIGS).where(F.col("id") > F.col("head")).select("id", "key", F.col("head").alias("root"), differ.cast("int").alias("bits"))


def near_duplicates(docs: DataFrame, agree: int = 0) -> DataFrame:
    """(doc_id_a, doc_id_b, bits): every near duplicate b with the document a that stays for its group.

    No pair within ``MAX_BITS`` is left out, unless ``agree`` asks for the search by keys.

    Defined cases: documents with no word (null, empty, blank or punctuation-only texts) and null doc_ids
    have no duplicates; repeated rows are one document; rows that share a doc_id but not the text are each
    compared, never with each other, and may have a row for each of their groups (``bits`` is the least of a
    pair's); the lowest doc_id of a group stays; documents of equal word sets are duplicates whatever the
    order of words; other columns are not read.
    """
    return groups(docs, agree).groupBy(F.col("root").alias("doc_id_a"), F.col("id").alias("doc_id_b")).agg(F.min("bits").alias("bits"))


def drop_near_duplicates(docs: DataFrame, agree: int = 0) -> DataFrame:
    """``docs`` without the rows that have a near duplicate of lower doc_id in their group; cases as above.

    Rows go by doc_id and text, so of each group the text of its lowest doc_id stays, also where doc_ids clash.
    """
    gid, gkey = fresh(docs, "qw_id", "qw_key")
    gone = groups(docs, agree).select(F.col("id").alias(gid), F.col("key").alias(gkey)).distinct()
    keyed = docs.withColumns({gid: F.col("doc_id").cast("long"), gkey: F.xxhash64("text")})
    return keyed.join(gone, [gid, gkey], "left_anti").select(*docs.columns)
