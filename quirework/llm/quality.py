"""Quality rules: logistic regression on hashed word and character n-grams, calibrated, in Arrow batches.

Features are hashed into ``2**bits`` slots: words (lower case, no outer punctuation), word pairs (a repeated word is one pair of its own,
whatever the word) and the 3- and 4-byte pieces of each word with its blanks.  Two models share them:

* ``quality`` takes each family's slots as shares of the text, so length doesn't matter;
* ``toxic`` takes how often each slot occurs, with an L1 penalty: a few words decide, not the average.

Each is trained on a bounded sample of labelled rows, and its scores are turned into probabilities by
a logistic curve (Platt) fitted on rows that training didn't see.  A document is kept when its quality
is at least ``min_quality`` and its toxicity below ``max_toxic``; both thresholds are fixed numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh
from .textbatch import Words, hash_words, mix64, plain, slices

#: Labelled rows that the models are fitted on, at most: those whose doc_id has the lowest hash.
TRAIN_ROWS = 3000
BITS = 17
MIN_QUALITY, MAX_TOXIC = 0.5, 0.3
#: Strength of the sparse model's penalty.
L1 = 0.1
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "\u2026\u2019\u201d\u201c\u00ab\u00bb\u00bf\u00a1"
REPEAT = np.uint64(0x5EED5EED5EED5EED)


def _pieces(words: pa.Array, sizes: tuple[int, ...] = (3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of every byte n-gram of `` word ``."""
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64))
    first = np.frombuffer(words.buffers()[1], np.int32, 1, words.offset * 4)[0]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[first : first + lengths.sum()] if lengths.sum() else np.zeros(0, np.uint8)
    ends = np.cumsum(lengths + 2)
    flat = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    owner = np.repeat(np.arange(len(words)), lengths + 2)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    inside[ends - 2 - lengths] = False
    flat[inside] = raw
    hashes, owners = [], []
    for n in sizes:
        if len(flat) < n:
            continue
        code = np.full(len(flat) - n + 1, n, np.uint64)
        for j in range(n):
            code = code << np.uint64(8) | flat[j : len(flat) - n + 1 + j].astype(np.uint64)
        same = owner[: len(code)] == owner[n - 1 :]
        hashes.append(code[same])
        owners.append(owner[: len(code)][same])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


class Features:
    """The three families of a text slice: per distinct word its piece slots, per token word and pair slots."""

    def __init__(self, texts: pa.Array, bits: int):
        mask = np.uint64((1 << bits) - 1)
        w = self.words = Words(texts)
        bare = pc.utf8_trim(pc.utf8_lower(w.dictionary), characters=PUNCTUATION)
        h = hash_words(bare)
        pieces, self.piece_word = _pieces(w.dictionary)
        self.piece = (mix64(pieces) & mask).astype(np.int64)
        self.word = (mix64(h ^ np.uint64(0xA5A5A5A5)) & mask).astype(np.int64)  # by distinct word
        a, b = w.codes[:-1], w.codes[1:]
        inner = w.doc[:-1] == w.doc[1:]
        a, b, self.pair_doc = a[inner], b[inner], w.doc[:-1][inner]
        pair = np.where(a == b, REPEAT, mix64(h[a] * np.uint64(3) + np.uint64(1)) ^ h[b]) if len(a) else np.zeros(0, np.uint64)
        self.pair = (mix64(pair) & mask).astype(np.int64)
        n = len(texts)
        pieces_of = np.bincount(self.piece_word, minlength=len(h)).astype(np.float64)
        self.totals = np.stack([np.bincount(w.doc, pieces_of[w.codes], n), np.bincount(w.doc, minlength=n), np.bincount(self.pair_doc, minlength=n)], 1)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """(rows, 3): each family's sum of weights."""
        w, n = self.words, self.words.rows
        by_word = np.bincount(self.piece_word, weights[0][self.piece], len(self.word))
        return np.stack([np.bincount(w.doc, by_word[w.codes], n), np.bincount(w.doc, weights[1][self.word[w.codes]], n), np.bincount(self.pair_doc, weights[2][self.pair], n)], 1)

    def counts(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(slot with family in the high bits, count) of each row; used in training only."""
        w = self.words
        order = np.argsort(self.piece_word, kind="stable")
        starts = np.searchsorted(self.piece_word[order], np.arange(len(self.word) + 1))
        edges = np.searchsorted(w.doc, np.arange(w.rows + 1))
        pair_edges = np.searchsorted(self.pair_doc, np.arange(w.rows + 1))
        for r in range(w.rows):
            codes = w.codes[edges[r] : edges[r + 1]]
            kinds, times = np.unique(codes, return_counts=True)
            parts = [self.piece[order[starts[k] : starts[k + 1]]] for k in kinds]
            slots = np.concatenate([*parts, self.word[kinds] + (1 << bits), self.pair[pair_edges[r] : pair_edges[r + 1]] + (2 << bits)]) if len(kinds) else np.zeros(0, np.int64)
            weight = np.concatenate([np.repeat(times, [len(p) for p in parts]), times, np.ones(pair_edges[r + 1] - pair_edges[r])]) if len(kinds) else np.zeros(0)
            distinct, at = np.unique(slots, return_inverse=True)
            yield distinct.astype(np.int32), np.bincount(at, weight, len(distinct)).astype(np.float32)


@dataclass
class Model:
    """Weights by family and slot; probability = 1 / (1 + exp(-(a * score + b)))."""

    weights: np.ndarray
    bias: float
    a: float
    b: float
    shares: bool

    def probability(self, features: Features) -> np.ndarray:
        s = features.sums(self.weights)
        if self.shares:
            s = s / np.maximum(features.totals, 1)
        return _sigmoid(self.a * (s.sum(1) + self.bias) + self.b)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with backtracking for P(y) = sigmoid(a * score + b), with Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))

    def loss(a: float, b: float) -> float:
        z = a * score + b
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-7 * a * a)

    a, b = 0.0, float(np.log((up + 1) / (down + 1)))
    now = loss(a, b)
    for _ in range(100):
        p = _sigmoid(a * score + b)
        g = np.array([((p - target) * score).sum() + 1e-6 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * score * score).sum() + 1e-6, (v * score).sum()], [(v * score).sum(), v.sum() + 1e-6]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-10 and not (then := loss(a - size * step[0], b - size * step[1])) < now - 1e-4 * size * (g @ step):
            size /= 2
        if size <= 1e-10 or np.abs(g).max() < 1e-9:
            break
        a, b, now = a - size * step[0], b - size * step[1], then
    return (a, b) if a > 0 else (1.0, 0.0)


@dataclass
class Sample:
    """Slot counts of all rows as flat arrays of (slot, count, row); chunked reads keep temporaries small."""

    col: np.ndarray
    val: np.ndarray
    row: np.ndarray
    rows: int

    @staticmethod
    def of(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Sample:
        cols, vals, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], []
        for slots, counts in pairs:
            cols.append(slots)
            vals.append(counts)
            sizes.append(len(slots))
        return Sample(np.concatenate(cols), np.concatenate(vals), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes))

    def chunks(self, size: int = 1 << 19) -> Iterator[slice]:
        for k in range(0, len(self.col), size):
            yield slice(k, k + size)

    def totals(self, bits: int) -> np.ndarray:
        """(rows, 3): each family's count."""
        out = np.zeros(self.rows * 3)
        for part in self.chunks():
            out += np.bincount(self.row[part].astype(np.int64) * 3 + (self.col[part] >> bits), self.val[part], self.rows * 3)
        return out.reshape(-1, 3)

    def values(self, part: slice | np.ndarray, totals: np.ndarray | None, bits: int) -> np.ndarray:
        if totals is None:
            return self.val[part].astype(np.float64)
        return self.val[part] / totals[self.row[part], self.col[part] >> bits]


def _telling(sample: Sample, totals: np.ndarray | None, y: np.ndarray, fits: np.ndarray, bits: int, most: int) -> np.ndarray:
    """Which slots to train on: those whose means differ most between the labels, in standard errors.

    Shares are compared where ``totals`` are given, occurrence otherwise.
    """
    slots, n1 = 3 << bits, max(1.0, y[fits].sum())
    n0 = max(1.0, fits.sum() - n1)
    sums = np.zeros((2, slots))
    squares = np.zeros((2, slots))
    for part in sample.chunks():
        r, c = sample.row[part], sample.col[part]
        v = np.ones(len(c)) if totals is None else sample.values(part, totals, bits)
        for k in (0, 1):
            w = v * (fits & (y == k))[r]
            sums[k] += np.bincount(c, w, slots)
            squares[k] += np.bincount(c, w * v, slots)
    a1, a0 = sums[1] / n1, sums[0] / n0
    floor = (squares[0] + squares[1]) / (n1 + n0) / 10
    z = np.abs(a1 - a0) / np.sqrt((squares[1] / n1 - a1**2 + floor) / n1 + (squares[0] / n0 - a0**2 + floor) / n0 + 1e-18)
    out = np.zeros(slots, bool)
    out[np.argsort(-z, kind="stable")[:most]] = True
    return out & (z > 0)


def _adam(slope, size: int, n: int, square: np.ndarray, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam with a trace of L2."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        g, gb = slope(w[:-1], w[-1])
        g = np.append(g + 1e-6 * w[:-1], gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def _sparse(slope, size: int, n: int, square: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal steps, slot by slot scaled, under an L1 penalty that shrinks as rows grow."""
    penalty = L1 * np.sqrt(np.log(size + 2) / n)
    step = np.append(0.25 / (square + square.sum() * 0.02 + 1e-3), 0.5)
    w = z = np.zeros(size + 1)
    t = 1.0
    for _ in range(rounds):
        g, gb = slope(z[:-1], z[-1])
        new = z - step * np.append(g, gb)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step[:-1] * penalty, 0)
        if (np.append(g, gb) * (new - w)).sum() > 0:
            t = 1.0  # restart when the momentum points uphill
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


def fit(sample: Sample, y: np.ndarray, held_out: np.ndarray, use: np.ndarray, shares: bool, bits: int = BITS) -> Model:
    """Weights from the rows in ``use`` that aren't held out, classes weighing alike; calibrated on the others."""
    fits = use & ~held_out
    totals = sample.totals(bits) if shares else None
    chosen = _telling(sample, totals, y, fits, bits, 20_000 if shares else 1_000)
    used = np.flatnonzero(chosen)
    place = np.full(len(chosen), -1, np.int64)
    place[used] = np.arange(len(used))
    scale = 30.0 if shares else 1.0
    parts = []
    for part in sample.chunks():
        keep = np.flatnonzero(chosen[sample.col[part]]) + part.start
        parts.append((place[sample.col[keep]], sample.row[keep].astype(np.int64), sample.values(keep, totals, bits) * scale))
    at, row, x = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    del parts
    n = max(1, fits.sum())
    up = y[fits].sum()
    balance = np.where(y == 1, 0.5 * n / max(1, up), 0.5 * n / max(1, n - up)) * fits
    rows = sample.rows

    def slope(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        e = (_sigmoid(np.bincount(row, x * w[at], rows) + bias) - y) * balance / n
        return np.bincount(at, x * e[row], len(used)), float(e.sum())

    w, bias = (_adam if shares else _sparse)(slope, len(used), n, np.bincount(at, x * x * balance[row], len(used)) / n)
    score = np.bincount(row, x * w[at], rows) + bias
    on = use & held_out if len(set(y[use & held_out])) == 2 else use
    a, b = _platt(score[on], y[on])
    weights = np.zeros((3, 1 << bits))
    weights[used >> bits, used & ((1 << bits) - 1)] = w * scale
    return Model(weights.astype(np.float32), float(bias), float(a), float(b), shares)


@dataclass
class Models:
    """None where the labels don't have both kinds."""

    quality: Model | None
    toxic: Model | None


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """(h, quality, toxic, slots, counts), the last two as little-endian int32 and float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                pairs = list(Features(plain(batch.column(0)), bits).counts(bits))
                slots = pa.array([s.tobytes() for s, _ in pairs], pa.binary())
                counts = pa.array([c.tobytes() for _, c in pairs], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], slots, counts], names)

    names = ["h", "quality", "toxic", "slots", "counts"]
    return docs.select("text", "h", "quality", "toxic").mapInArrow(run, "h long, quality int, toxic int, slots binary, counts binary")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, bits: int = BITS) -> Models:
    """Models from at most ``max_rows`` labelled rows: those whose doc_id has the lowest hash.

    The bound holds for labels, texts and driver alike: the ids that are broadcast to find the texts are at
    most ``max_rows``, and the driver gets the sample's slot counts, not its texts.  A label row with a
    null doc_id or null label is left out; of a doc_id with several labels the lowest is taken.
    """
    spark = docs.sparkSession
    clean = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int"), F.col("toxic").cast("int")).where("id is not null and (quality is not null or toxic is not null)")
    sample = clean.groupBy("id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    sample = sample.withColumn("h", F.xxhash64(F.lit(17), "id")).orderBy("h", "id").limit(max_rows)
    rows = [(r["id"], r["h"], r["quality"], r["toxic"]) for r in sample.collect()]
    if not rows:
        return Models(None, None)
    small = F.broadcast(spark.createDataFrame(rows, "id long, h long, quality int, toxic int"))
    found = docs.where("text is not null").select("doc_id", "text").join(small, F.col("doc_id") == F.col("id"))
    counted = _counted(found.drop("doc_id", "id"), bits)
    marks: list[tuple] = []
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for r in counted.toLocalIterator():  # a partition of the sample at a time
        marks.append((r["h"], r["quality"], r["toxic"]))
        pairs.append((np.frombuffer(bytes(r["slots"]), np.int32), np.frombuffer(bytes(r["counts"]), np.float32)))
    order = sorted(range(len(marks)), key=lambda i: (marks[i][0], len(pairs[i][0]), pairs[i][0].tobytes()[:64]))
    table = Sample.of(pairs[i] for i in order)
    del pairs
    h = np.array([marks[i][0] for i in order], dtype=np.int64)
    out = []
    for k, shares in ((1, True), (2, False)):
        y = np.array([np.nan if marks[i][k] is None else marks[i][k] for i in order], dtype=float)
        use = ~np.isnan(y)
        if len(set(y[use])) < 2:
            out.append(None)
            continue
        held = use & ((h // 7 % 4) == 0)
        if len(set(y[use & ~held])) < 2:
            held[:] = False
        out.append(fit(table, np.nan_to_num(y), held, use, shares, bits))
    del table
    _give_back()
    return Models(*out)


def _give_back() -> None:
    """Let the allocator return what training has freed: the driver goes on for long after."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def score(docs: DataFrame, models: Models, names: tuple[str, str] = ("p_quality", "p_toxic"), bits: int = BITS) -> DataFrame:
    """``docs`` with two probabilities; null where there is no model or the text has no word.  Narrow."""
    columns = docs.columns
    text_at = columns.index("text")
    out_names = [*columns, *fresh(docs, *names)]
    held = docs.sparkSession.sparkContext.broadcast(models)  # 2 x 3 x 2**bits weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at, 4 << 20):
                f = Features(plain(batch.column(text_at)), bits)
                blank = f.totals[:, 1] == 0
                extra = [pa.nulls(batch.num_rows, pa.float64()) if m is None else pa.array(m.probability(f), pa.float64(), mask=blank) for m in (held.value.quality, held.value.toxic)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], out_names)

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in out_names[-2:]]])
    return docs.mapInArrow(run, schema)


def accepted(quality, toxic):
    """The rule on two probability columns: a null one doesn't reject."""
    return (F.coalesce(quality, F.lit(1.0)) >= MIN_QUALITY) & (F.coalesce(toxic, F.lit(0.0)) < MAX_TOXIC)


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with ``p_quality`` and ``p_toxic`` (the next free names if taken).

    Defined cases: null, empty and blank texts have no words, get null probabilities and are kept; without
    usable labels of both kinds a model is missing, its probability is null and it rejects nothing; equal
    rows score alike; other columns pass unchanged.  Whole texts are scored, however long.
    """
    q, t = fresh(docs, "p_quality", "p_toxic")
    return score(docs, train(docs, labels, max_rows)).where(accepted(F.col(q), F.col(t)))
