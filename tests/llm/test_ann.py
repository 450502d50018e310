import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], d[j]) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v], 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, rank int")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9000, 32)).astype("float32").astype("float64")
    x[100:500] = x[0]  # one vector many times
    ids = np.arange(9000)
    got = found(ann.search(frame(spark, ids, x), F.col("vec_id") % 100 == 0))
    want = brute(ids, x, range(0, 9000, 100), 10)
    assert set(got) == set(want)
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert got[0] == want[0]  # copies: distance 0, smallest ids
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near, key=lambda p: (p[1], p[0]))
        for i, d in near[:3]:
            assert d == pytest.approx(np.sqrt(((x[q] - x[i]) ** 2).sum()), abs=1e-12)


def test_few_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (100, [1.0, 0.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.search(df, F.col("vec_id") % 100 == 0))
    assert [i for i, _ in got[0]] == [100, 100, 1]
    assert sorted(i for i, _ in got[100]) == [0, 0, 1, 1, 100, 100]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id = 3"), F.col("vec_id") % 100 == 0).count() == 0
