import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rankweave.functions import ranks as R
from rankweave.operators import bounds as B
from rankweave.operators import digest as D
from rankweave.operators import joins as J
from rankweave.operators import windows as X
from rankweave.plans import mining as M
from rankweave.sources import series as S

EXAMPLE = "15 32 29 27 34 33 25 20 28 23"


def shape(win):
    return None if len(set(win)) < len(win) else tuple(sorted(win).index(v) + 1 for v in win)


def supports(t, k, lo, hi):
    out = {}
    for m in range(lo, min(hi, len(t)) + 1):
        for e in range(m - 1, len(t)):
            if (r := shape(t[e - m + 1 : e + 1])) is not None:
                out[r] = out.get(r, 0.0) + math.exp(-k * (len(t) - 1 - e))
    return out


def brute(t, k, topk, lo, hi):
    found = supports(t, k, lo, hi)
    return [(r, round(s, 9)) for r, s in sorted(found.items(), key=lambda x: (-round(x[1], 12), len(x[0]), x[0]))[:topk]]


def levelwise(t, k, least, hi):
    found = supports(t, k, 2, hi)
    strip = lambda r: shape(r)
    kept = set()
    for r in sorted(found, key=len):
        if found[r] + 1e-12 >= least and (len(r) == 2 or strip(r[:-1]) in kept and strip(r[1:]) in kept):
            kept.add(r)
    return kept


def frame(spark, many):
    return spark.createDataFrame([(str(i), p, float(v)) for i, t in enumerate(many) for p, v in enumerate(t)], "series_id string, pos int, value double")


def answer(df):
    out = {}
    for r in df.orderBy("series_id", "rank").collect():
        out.setdefault(r.series_id, []).append((tuple(r.ranks), round(r.support, 9)))
    return out


def random_series():
    rng = random.Random(20)
    many = [[int(x) for x in EXAMPLE.split()]]
    for n in (5, 6, 7, 8, 9, 14):
        many.append(rng.sample(range(n), n))
        many.append([rng.randrange(4) for _ in range(n)])
    return many + [[1.0] * 5, [1, 3, 2], list(range(8)), [0.0, -0.0, 1.0], [float("nan"), float("nan"), 1.0]]


def test_example(spark):
    df = S.from_text(spark.createDataFrame([("a", EXAMPLE + " ,\n")], "id string, t string"), F.col("id"), F.col("t"))
    top = answer(M.top_k_one_pass(df, 5, k=0.1))["a"]
    assert [r for r, _ in top] == [(2, 1), (1, 3, 2), (3, 2, 1), (1, 2), (2, 1, 3)]
    assert [s for _, s in top] == [4.275265960, 2.166905350, 2.108360610, 1.960697042, 1.511368078]
    ends = {tuple(r.ranks): r.ends for r in M.top_k_one_pass(df, 5, k=0.1, ends=True).select("ranks", R.one_based(F.col("ends")).alias("ends")).collect()}
    assert ends[(2, 1)] == [3, 4, 6, 7, 8, 10] and ends[(2, 1, 3)] == [5, 9]
    for least, level, plain in ((1.5, 5, 5), (1.0, 6, 12), (0.6, 26, 32)):
        assert M.threshold(df, least, 10, 0.1).count() == level
        assert M.threshold_complete(df, least, 10, 0.1).count() == plain


def test_plans_agree_with_brute_force(spark):
    many = random_series()
    df = frame(spark, many).withColumn("value", F.col("value") + 0.0).cache()
    clean = [[float(v) + 0.0 for v in t] for t in many[:-1]]
    for topk, lo, hi, k in ((3, 2, 5, 0.1), (50, 3, 6, 0.3)):
        plain = answer(M.top_k_one_pass(df, topk, lo, hi, k))
        for i, t in enumerate(clean):
            assert plain.get(str(i), []) == brute(t, k, topk, lo, hi)
        assert plain.get(str(len(clean)), []) == [] if lo > 2 else plain[str(len(clean))][0][0] == (2, 1)
        for pdub, dub in ((True, True), (False, False)):
            assert answer(M.top_k_pruned(df, topk, lo, hi, k, use_pdub=pdub, use_dub=dub).top) == plain
    got = {}
    for r in M.threshold(df, 0.7, 5, 0.1).collect():
        got.setdefault(r.series_id, set()).add(tuple(r.ranks))
    for i, t in enumerate(clean):
        assert got.get(str(i), set()) == levelwise(t, 0.1, 0.7, 5)


def test_chunks_and_ranges(spark):
    rng = random.Random(4)
    t = [rng.random() for _ in range(200)]
    df = frame(spark, [t, t[:7]])
    whole = {(r.series_id, r.pos, r.m, tuple(r.ranks)) for r in X.occurrences(df, 2, 5).collect()}
    for chunk in (1, 3, 64):
        assert {(r.series_id, r.pos, r.m, tuple(r.ranks)) for r in X.occurrences(df, 2, 5, chunk).collect()} == whole
    rows = df.withColumn("o", F.col("pos") * 3).drop("pos").repartition(5)
    want = {tuple(r) for r in df.collect()}
    assert {tuple(r) for r in S.from_large_table(rows, F.col("series_id"), ["o"], F.col("value"), 4).collect()} == want
    assert {tuple(r) for r in S.from_table(rows, F.col("series_id"), ["o"], F.col("value")).collect()} == want


def test_fusions(spark):
    perms = [p for m in (2, 3, 4) for p in itertools.permutations(range(1, m + 1))]
    pats = spark.createDataFrame([("s", list(p)) for p in perms], "series_id string, ranks array<int>")
    got = {}
    for m in (2, 3, 4):
        for r in J.pair_join(pats.where(F.size("ranks") == m)).select("p", "q", R.fusions(F.col("p"), F.col("q")).alias("c")).collect():
            got[tuple(r.p), tuple(r.q)] = {tuple(c) for c in r.c}
    want = {}
    for m in (2, 3, 4):
        for c in itertools.permutations(range(1, m + 2)):
            want.setdefault((shape(c[:-1]), shape(c[1:])), set()).add(c)
    assert got == want


def test_bounds(spark):
    t = [int(x) for x in EXAMPLE.split()]
    k, n = 0.1, len(t)
    pr = B.profiles(X.occurrences(frame(spark, [t]), 2, 3), 4, k).cache()
    for r in pr.collect():
        ends = [e for e in range(r.m - 1, n) if shape(t[e - r.m + 1 : e + 1]) == tuple(r.ranks)]
        for d in range(5):
            want = math.exp(k * d) * sum(math.exp(-k * (n - 1 - e)) for e in ends if e <= n - 1 - d)
            assert r.ub[d] == pytest.approx(want, abs=1e-12)
    ext = supports(t, k, 2, 7)
    for r in pr.select("m", "ranks", B.dub(F.col("ub")).alias("b")).collect():
        below = [s for q, s in ext.items() if r.m <= len(q) <= r.m + 4 and shape(q[: r.m]) == tuple(r.ranks)]
        assert r.b + 1e-9 >= max(below)


def test_errors(spark):
    df = frame(spark, [[1, 2, 3]])
    for bad in ({"topk": 0}, {"topk": 1, "min_len": 1}, {"topk": 1, "min_len": 4, "max_len": 3}, {"topk": 1, "k": 0.0}, {"topk": 1, "k": float("nan")}):
        with pytest.raises(ValueError):
            M.top_k_one_pass(df, **bad).collect()
    with pytest.raises(ValueError):
        M.mine(df, "no such mode")
    with pytest.raises(Exception):
        S.from_text(spark.createDataFrame([("a", ",1 2")], "id string, t string"), F.col("id"), F.col("t")).collect()
    assert M.threshold(frame(spark, [[1]]), 0.5, 1, 0.1).count() == 0 and M.threshold(df, 0.5, 1, 0.1).count() == 1


def test_digest(spark):
    import hashlib

    df = frame(spark, [[int(x) for x in EXAMPLE.split()]])
    top = M.top_k_one_pass(df, 5, k=0.1, ends=True)
    lines = "".join(f"({','.join(map(str, r.ranks))})\t{r.support:.12f}\n" for r in top.orderBy("rank").collect())
    assert D.digests(top).first().sha256 == hashlib.sha256(lines.encode()).hexdigest()


def test_bounds_of_deep_searches_hold(spark):
    """The shared bound of all depths beyond the single ones is no less than any of theirs."""
    rng = random.Random(4)
    n = 130
    df = spark.createDataFrame([("a", i, rng.random()) for i in range(n)], "series_id string, pos int, value double")
    occurred = X.occurrences(df, 3, 3).cache()
    ends = {}
    for r in occurred.collect():
        ends.setdefault(tuple(r.ranks), []).append(r.pos)
    got = {tuple(r.ranks): r.ub for r in B.profiles(occurred, n - 3, None).collect()}
    for p, own in ends.items():
        ub = got[p]
        assert len(ub) == B.DENSE + 2 and ub[-1] == ub[-2]
        each = [sum(math.exp(-(n - 1 - e - d) / n) for e in own if e <= n - 1 - d) for d in range(n - 2)]
        assert ub[: B.DENSE] == pytest.approx(each[: B.DENSE])
        assert max(each[B.DENSE :]) <= ub[-1] + 1e-12 <= 1.3 * max(each[B.DENSE :]) + 1e-9


def test_search_without_a_length_limit(spark):
    """maxLen 0 stands for the series' length, and the search ends with the last level that can matter."""
    rng = random.Random(5)
    df = spark.createDataFrame([("a", i, rng.random()) for i in range(110)], "series_id string, pos int, value double")
    got = [(r.pattern, r.n_occ, round(r.support, 9)) for r in M.mine(df, "tk", 5).orderBy("rank").collect()]
    want = [(r.pattern, r.n_occ, round(r.support, 9)) for r in M.top_k_one_pass(df, 5, 2, 8).orderBy("rank").collect()]
    assert got == want


def test_seeds_by_chunks(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([3, 1, 1, 2, 5, 4, 4])], "series_id string, pos int, value double")
    got = {r.pos: r.ranks for r in X.seeds(df, chunk=2).collect()}
    assert got == {1: [2, 1], 2: None, 3: [1, 2], 4: [1, 2], 5: [2, 1], 6: None}
