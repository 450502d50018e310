import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, note string"


def direct(vectors):
    """All results by numpy and whole numbers of any size."""
    size = max({len(v) for v in vectors}, key=lambda k: (sum(len(v) == k for v in vectors), k))
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors if len(v) == size]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    e, v = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-e)
    return n, sums, e[order], v[:, order].T


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    # falling scales, an offset, repeated rows
    rows = (rng.normal(size=(400, 20)) * np.geomspace(8, 0.5, 20) + 3).astype("float32").tolist()
    return rows + rows[:150] + [rows[0]] * 200


def test_against_eigenvectors(spark, vectors):
    odd = [None, [1.0, None] + [0.0] * 18, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [], [1.0] * 7]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in enumerate(vectors + odd)], SCHEMA).repartition(9)
    got = W.whiten(df, keep=("vec_id", "n", "note")).collect()
    n, sums, e, v = direct(vectors)
    assert len(got) == 16 * len(vectors) and {r.component for r in got} == set(range(1, 17)) and {r.n for r in got} == {n} and {r.note for r in got} == {"x"}
    assert {r.vec_id for r in got} == set(range(len(vectors)))
    error = {r.identity_error for r in got}
    assert len(error) == 1 and 0 <= error.pop() < 1e-9
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in np.float32(row)] for row in vectors])
    want = ((x * n - np.array(sums)) / n) @ v.T / np.sqrt(e)
    far = ((x * n - np.array(sums)) ** 2).sum(axis=1)
    by = np.zeros((len(vectors), 16))
    for r in got:
        by[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == far[r.vec_id] and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    for c in range(16):
        sign = np.sign(by[0, c] * want[0, c])
        assert by[:, c] == pytest.approx(sign * want[:, c], abs=1e-7)


def test_small_deviations_keep_their_digits():
    """Of a matrix with columns of very different size, singular values that a covariance would lose."""
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(40, 6)))
    scale = np.array([1e6, 1e3, 1, 1e-3, 1e-6, 1e-9])
    components, sigma = W.jacobi(q * scale)
    assert sigma == pytest.approx(scale, rel=1e-12) and np.abs(components @ components.T - np.eye(6)).max() < 1e-12


def test_partial_results_in_rounds(spark, vectors, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    df = W.quantised(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"))
    rows = df.select("__x").distinct().repartition(11)
    n, sums = W.totals(rows)
    r = W.tsqr(rows, W.Centre(n, sums))
    _, want, e, _ = direct(vectors)
    assert sums == want and r.shape == (20, 20) and np.linalg.eigvalsh(r.T @ r / n)[::-1] == pytest.approx(e, rel=1e-9)


def test_corner_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert W.whiten(none).count() == 0
    one = spark.createDataFrame([(i, [1.0, 2.0], 1, "") for i in range(5)], SCHEMA)
    assert W.whiten(one).count() == 0
    flat = spark.createDataFrame([(i, [float(i % 3), 2.0], 1, "") for i in range(9)], SCHEMA)
    got = W.whiten(flat).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and {r.explained for r in got} == {1.0}
    huge = spark.createDataFrame([(1, [3e38, 0.0], 1, ""), (2, [-3e38, 1.0], 1, ""), (3, [5.0, 2.0], 1, "")], SCHEMA)
    assert {r.deviation for r in W.whiten(huge).where("vec_id < 3").collect()} == {None}


def test_whole_numbers_beyond_products_of_longs():
    centre = W.Centre(3, [3 * (1 << 40) + 1, 7])
    x = np.array([[1 << 40, 2], [(1 << 40) + 5, 3], [(1 << 40) + (1 << 29), 2]])
    want = [(3 * a - (3 * (1 << 40) + 1)) ** 2 + (3 * b - 7) ** 2 for a, b in x.tolist()]
    assert centre.deviations(x) == want


def test_query_columns(spark):
    from rankweave.llm import queries

    df = queries.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001")
    assert [(c, t) for c, t in df.dtypes] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert df.agg(F.count("*"), F.max("identity_error")).first()[0] == 16 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
