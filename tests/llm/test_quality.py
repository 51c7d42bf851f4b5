"""Held-out accuracy, and the fast scorer against a plain re-computation."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quirework.llm import quality
from quirework.llm.quality import Features, _platt, _sigmoid, quality_rules

GOOD = "the river runs past old houses where people read books about history and law every evening".split()
BAD = "click buy cheap now winner free bonus spam deal offer casino".split()


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good, toxic = rng.random() < 0.6, rng.random() < 0.25
        words = [rng.choice(GOOD if good else BAD) for _ in range(rng.randint(30, 90))]
        if toxic:
            words[rng.randrange(len(words))] = "vilename"
            words[rng.randrange(len(words))] = "slurword"
        out.append((i, " ".join(words), int(good), int(toxic)))
    return out


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs):
    rows = rows_of(1500, 1)
    out = quality_rules(docs([(i, t) for i, t, _, _ in rows]), labels_of(spark, rows[:900]))
    kept = {r["doc_id"] for r in out.collect()}
    rest = rows[900:]
    clean, toxic, poor = ([i in kept for i, _, q, t in rest if f(q, t)] for f in (lambda q, t: q and not t, lambda q, t: t, lambda q, t: not q))
    assert np.mean(clean) > 0.95 and np.mean(toxic) < 0.1 and np.mean(poor) < 0.05


def test_scorer_equals_plain_sums():
    texts = ["Some words, some again. Été", "", "x", "a a a b"]
    f = Features(pa.array(texts), 10)
    weights = np.random.default_rng(0).normal(size=(3, 1 << 10))
    want = [[sum(c * weights[k][s - (k << 10)] for s, c in zip(slots, counts, strict=True) if s >> 10 == k) for k in range(3)] for slots, counts in f.counts(10)]
    assert np.allclose(f.sums(weights), want)


def test_calibration_meets_its_base_rate_in_spite_of_outliers():
    rng = np.random.default_rng(2)
    y = (rng.random(200) < 0.15).astype(float)
    score = np.where(y == 1, 2.0, -1.0) + rng.normal(size=200)
    score[np.flatnonzero(y == 1)[0]] = -40
    a, b = _platt(score, y)
    assert abs(_sigmoid(a * score + b).mean() - y.mean()) < 0.02


def test_cases(spark, docs):
    rows = rows_of(300, 3)
    df = docs([(i, t) for i, t, _, _ in rows] + [(900, None), (901, ""), (902, " \n "), (None, rows[0][1]), (903, "river " * 200000)])
    df = df.withColumns({c: F.lit("x") for c in ("h", "id", "quality", "toxic", "p_quality", "slots")})
    odd = labels_of(spark, rows).union(spark.createDataFrame([(None, 1, 1), (0, None, None), (12345, 1, 0)], "doc_id long, quality int, toxic int"))
    out = quality_rules(df, odd)
    assert out.columns == [*df.columns, "p_quality_1", "p_toxic"]
    kept = {r["doc_id"]: r for r in out.collect()}
    assert all(kept[i]["p_quality_1"] is None for i in (900, 901, 902)) and 903 in kept


def test_without_usable_labels_nothing_goes(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules(docs(["a b", "c d"]), empty).count() == 2
    assert quality_rules(docs(["a b", "c d"]), one_kind).count() == 2
    assert quality_rules(docs([]), empty).count() == 0


def test_the_bound_on_training_rows_holds(spark, docs):
    rows = rows_of(200, 4)
    sizes = []
    real = quality.fit
    quality.fit = lambda sample, *rest: (sizes.append(sample.rows), real(sample, *rest))[1]
    try:
        quality.train(docs([(i, t) for i, t, _, _ in rows]), labels_of(spark, rows), max_rows=50)
    finally:
        quality.fit = real
    assert sizes == [50, 50]
