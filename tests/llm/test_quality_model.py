import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import quality_model as Q
from rankweave.llm import quality_rules


def test_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, p = Q.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) > 0).all() and 0 <= p[0] and p[-1] <= 1


def test_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    z = Q.Cosines(np.zeros(8), np.ones(8), features=20000)(x)[:, :-1]
    want = np.exp(-Q.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_scores(spark):
    rng = random.Random(3)
    words = ["house", "water", "green", "Stone", "over", "the", "and"]
    good = lambda: " ".join(rng.choice(words) for _ in range(80))
    bad = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(20)) * 3
    rows = [(i, good() if i % 3 else bad(), 0.1) for i in range(300)] + [(1000, None, 0.1), (1001, "", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(1, None), (7777, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == (i % 3 > 0) for i in range(1, 300, 2)]
    assert sum(right) >= 0.95 * len(right)
    none = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), none).count() == 0


def test_isotonic_against_brute_force():
    """Each value is the largest, over starts up to it, of the least mean of what follows to some end from it on."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        x, y = np.sort(rng.normal(size=n)), rng.integers(0, 2, n).astype(float)
        at, p = Q.isotonic(x, y)
        want = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        # blocks are given by their mean scores; each row's block is the one whose rows hold it
        sizes, got, k = [], [], 0
        while k < n:
            run = 1
            while k + run < n and abs(want[k + run] - want[k]) < 1e-12:
                run += 1
            sizes.append(run)
            got.append(want[k])
            k += run
        assert p == pytest.approx(got)
        stops = np.cumsum([0, *sizes])
        assert at == pytest.approx([x[a:b].mean() for a, b in zip(stops, stops[1:])])


def test_weights_against_a_direct_solution(spark):
    """Sums by partitions give the ridge solution of all rows, with repeated rows and a very long text among them."""
    rng = random.Random(5)
    words = ["house", "Water", "green!", "Stone", "over", "###", "and", "x" * 30]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    texts += texts[:20] + ["water " * 60_000]
    rows = [(i, t, i % 2 if len(t) > 150 else 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, rows[0][2])], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    known = docs.join(labels, "doc_id")
    table = quality_rules.evaluated(known).select("quality", Q.statistics().alias("x"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(Q.FOLDS)).alias("fold")).collect()
    assert len(table) == len(rows) + 1
    x, y = np.array([r.x for r in table]), np.array([float(r.quality) for r in table])
    own = np.array([r.fold > 0 for r in table])
    assert model.cosines.mean == pytest.approx(x.mean(axis=0)) and model.cosines.scale == pytest.approx(np.where(x.std(axis=0) > 0, x.std(axis=0), 1))
    z = model.cosines(x[own])
    a = z.T @ z + Q.RIDGE * max(1.0, own.sum() / 1000) * np.eye(z.shape[1])
    assert np.abs(model.cosines(x) @ (model.weights - np.linalg.solve(a, z.T @ y[own]))).max() < 1e-6
    steps = Q.isotonic(model.cosines(x[~own]) @ model.weights, y[~own])
    assert model.steps[0] == pytest.approx(steps[0]) and model.steps[1] == pytest.approx(steps[1])
