"""Work dealt by counted rows: no task takes what grows with a whole series."""

import random

from rankweave import queries as Q
from rankweave.functions import ranks as R
from rankweave.operators import windows as X
from rankweave.plans import grid as G
from rankweave.plans import mining as M
from rankweave.sources import series as S
from rankweave.sources import text_source as N

from pyspark.sql import functions as F


def table(spark, sizes, seed=3):
    rng = random.Random(seed)
    rows = [(s, i, rng.random()) for s, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "s string, o int, v double")


def test_long_series_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(S, "SHORT", 50)
    monkeypatch.setattr(X, "SHARE", 40)
    monkeypatch.setattr(S, "SHARE", 40)
    rows = table(spark, {"a": 300, "b": 20, None: 10})
    series = S.from_table(rows, F.col("s"), ["o"], F.col("v"), sizes=True)
    want = {(r.s, r.o, r.v) for r in rows.collect()}
    got = series.collect()
    assert {(r.series_id, r.pos, r.value) for r in got} == want and {(r.series_id, r.n) for r in got} == {("a", 300), ("b", 20), (None, 10)}
    windows = X.windows(series, 2, 3, 16)
    per_task = windows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert X.many(series) == 330 and windows.rdd.getNumPartitions() == 17 and per_task < 300


def test_campaign_ends_early(spark, monkeypatch):
    series = S.from_table(table(spark, {"a": 4000}), F.col("s"), ["o"], F.col("v"))
    seen, windows = [], X.windows
    monkeypatch.setattr(X, "windows", lambda s, lo, hi, *rest: (seen.append(hi), windows(s, lo, hi, *rest))[1])
    cells = (G.Cell("x", 1.0, 5, 12), G.Cell("x", 2.0, 30, 9))
    found = G.campaign(series, cells).collect()
    assert max(seen) <= 6
    monkeypatch.undo()
    for c in cells:
        want = {(r["rank"], tuple(r.ranks), r.n_occ, r.support) for r in M.top_k_one_pass(series, c.topk, 2, c.maxlen, times=c.factor).collect()}
        assert {(r["rank"], tuple(r.ranks), r.n_occ, r.support) for r in found if r.topk == c.topk} == want


def test_campaign_rising_series(spark):
    series = spark.createDataFrame([("up", i, float(i)) for i in range(40)], "series_id string, pos int, value double")
    found = G.campaign(series, (G.Cell("x", 1.0, 50, 16),)).collect()
    assert sorted(len(r.ranks) for r in found) == list(range(2, 17))


def test_fuse_join_needs_no_join(spark, tmp_path):
    rng = random.Random(5)
    rows = [(1, i, 1, 1, float(i), "A", "F", float(rng.randrange(9))) for i in range(200)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_linestatus string, l_quantity double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = Q.fuse_join(spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = X.pattern_counts(X.occurrences(Q.quantities(spark, str(tmp_path)), 4, 4)).select(R.compact(F.col("ranks")).alias("p"), "n_occ")
    assert {(r.pattern, r.n_occ) for r in out.collect()} == {(r.p, r.n_occ) for r in want.collect()}


def test_ranges_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "PARTS", 10)
    want = [float(i) for i in range(5000)]
    (tmp_path / "a.txt").write_text(", ".join(map(str, want)))
    reader = N.SeriesReader({"path": str(tmp_path), "range": "16"})
    assert len(reader.partitions()) <= 11
    monkeypatch.undo()
    got = sorted((r.pos, r.value) for r in N.read_series(spark, str(tmp_path), 16).collect())
    assert got == list(enumerate(want)) and len(N.SeriesReader({"path": str(tmp_path), "range": "16"}).partitions()) <= 257


def test_short_series_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARE", 100)
    series = S.from_table(table(spark, {str(i): 10 for i in range(100)}), F.col("s"), ["o"], F.col("v"), sizes=True)
    assert series.rdd.getNumPartitions() == 80 and X.windows(series, 2, 5).rdd.getNumPartitions() == 80


def test_long_pruned_leaves_windows_out(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(i, i, i % 3, rng.random()) for i in range(1500)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    asked, supports = [], G.grid_supports
    monkeypatch.setattr(G, "grid_supports", lambda x, f: (asked.append(x), supports(x, f))[1])
    got = {(r.series_id, r["rank"], r.pattern, r.n_occ) for r in Q.topk_long_pruned(spark, str(tmp_path)).collect()}
    assert 1 < len(asked) and sum(x.count() for x in asked) < 0.6 * X.occurrences(Q.events(spark, str(tmp_path)), 2, 12).count()
    assert got == {(r.series_id, r["rank"], r.pattern, r.n_occ) for r in Q.topk_long(spark, str(tmp_path)).collect()}


def test_large_series_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARE", 800)
    monkeypatch.setattr(S, "SHARE", 800)
    rows = table(spark, {str(i): 50 for i in range(40)})
    series = S.from_table(rows, F.col("s"), ["o"], F.col("v"), sizes=True)
    tasks = series.groupBy(F.spark_partition_id()).count()
    assert tasks.agg(F.max("count")).first()[0] <= 150 and series.count() == 2000
    counts = X.pattern_supports(X.occurrences(series, 2, 3))
    assert "Exchange hashpartitioning(series_id" not in counts._jdf.queryExecution().executedPlan().toString()
