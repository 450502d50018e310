import datetime
import hashlib
import itertools
import math
import os
import random
import shutil
import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import digest as D
from rankweave.operators import stats as T
from rankweave.operators import windows as X
from rankweave.plans import grid as G
from rankweave.plans import mining
from rankweave.sources import series as S
from rankweave.sources import sinks
from rankweave.sources import text_source as N
from rankweave.streaming import recency


def test_wilcoxon(spark):
    def brute(diffs):
        d = [x for x in diffs if x]
        size = sorted(map(abs, d))
        rank = [statistics.mean(i + 1 for i, s in enumerate(size) if s == abs(x)) for x in d]
        w = sum(r for r, x in zip(rank, d) if x > 0)
        all_ = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product([0, 1], repeat=len(d))]
        low, high = sum(x <= w + 1e-9 for x in all_), sum(x >= w - 1e-9 for x in all_)
        return len(d), w, min(1.0, 2 * min(low, high) / len(all_))

    for diffs in ([1.0, -2.0, 2.0, 3.5, 0.0, 4.0, -0.5, 2.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], [-1.0]):
        r = T.wilcoxon(spark.createDataFrame([(x,) for x in diffs], "diff double")).first()
        assert (r.m, r.w_plus, r.p) == pytest.approx(brute(diffs))


def test_wilcoxon_of_many(spark):
    """The rank sum's distribution in whole numbers, of 200 differences with ties, and of 18 by enumeration."""
    rng = random.Random(8)
    diffs = [float(rng.randrange(-60, 75)) for _ in range(200)]
    d = sorted((x for x in diffs if x), key=abs)
    size = [abs(x) for x in d]
    ranks = [2 * size.index(s) + size.count(s) + 1 for s in size]
    ways = [1]
    for r in ranks:
        ways = [a + b for a, b in zip(ways + [0] * r, [0] * r + ways, strict=True)]
    w = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    want = min(Fraction(1), 2 * min(Fraction(sum(ways[: w + 1]), 1 << len(d)), Fraction(sum(ways[w:]), 1 << len(d))))
    got = T.wilcoxon(spark.createDataFrame([(x,) for x in diffs], "diff double")).first()
    assert (got.m, got.w_plus) == (len(d), w / 2) and got.p == pytest.approx(float(want), rel=1e-9)
    few = [(-1) ** (i % 3) * float(i // 2) for i in range(20)]
    signs = list(itertools.product([0, 1], repeat=18))
    ranks = [2 * sorted(abs(x) for x in few if x).index(abs(x)) + 3 for x in few if x]
    w = sum(r for r, x in zip(ranks, (x for x in few if x), strict=True) if x > 0)
    sums = [sum(r for r, s in zip(ranks, own, strict=True) if s) for own in signs]
    got = T.wilcoxon(spark.createDataFrame([(x,) for x in few], "diff double")).first()
    assert got.p == pytest.approx(min(1.0, 2 * min(sum(x <= w for x in sums), sum(x >= w for x in sums)) / len(sums)))
    assert T.wilcoxon(spark.createDataFrame([(0.0,), (None,)], "diff double")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 8, 40])
def test_median_places_follow_the_law_of_resamples(n):
    """Distribution of the two middle places against resamples made one by one."""
    rng = np.random.default_rng(n)
    rounds = 60_000
    drawn = np.sort(T._median_places(n, (n + 1) // 2, rng, rounds), axis=0)
    made = np.sort(rng.integers(0, n, (rounds, n)), axis=1)[:, [(n - 1) // 2, n // 2]].T
    for own, other in ((drawn[0], made[0]), (drawn[1], made[1]), (drawn[0] * n + drawn[1], made[0] * n + made[1])):
        size = n * n + n
        gap = np.abs(np.cumsum(np.bincount(own, minlength=size) - np.bincount(other, minlength=size))).max() / rounds
        assert gap < 1.95 * math.sqrt(2 / rounds)  # Kolmogorov's bound at 0.1 %


def test_bootstrap(spark):
    """Intervals against resamples made one by one, one group far larger than the others, and the same again on another partitioning."""
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(10, 2, 301), "b": rng.normal(5, 1, 12), "c": np.array([4.0])}
    rows = [(g, "m", float(x)) for g, xs in groups.items() for x in xs] + [("a", "m", None)]
    runs = spark.createDataFrame(rows, "dataset string, mode string, runtime_ms double")
    got = {r.dataset: r for r in T.bootstrap_median(runs).collect()}
    again = {r.dataset: r for r in T.bootstrap_median(runs.repartition(7)).collect()}
    assert got == again
    for g, xs in groups.items():
        made = np.median(rng.choice(xs, (20_000, len(xs))), axis=1)
        width = max(np.ptp(np.percentile(made, [2.5, 97.5])), 1e-9)
        assert got[g].median == pytest.approx(np.median(xs))
        assert [got[g].lo, got[g].hi] == pytest.approx(list(np.percentile(made, [2.5, 97.5])), abs=0.15 * width)


def test_weight_prefixes_by_chunks(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(s, i, rng.random()) for s in "ab" for i in range(90)], "series_id string, pos int, value double")
    occurred = X.occurrences(df, 2, 3).cache()
    want = {}
    for r in sorted(occurred.collect(), key=lambda r: (r.series_id, r.m, r.ranks, r.pos)):
        key = (r.series_id, tuple(r.ranks))
        want[(*key, r.pos)] = want.get((*key, "sum"), 0.0) + math.exp(-0.05 * (r.n - 1 - r.pos))
        want[(*key, "sum")] = want[(*key, r.pos)]
    for chunk in (1, 7, 1000):
        got = {(r.series_id, tuple(r.ranks), r.pos): r.prefix for r in X.weight_prefixes(occurred, 0.05, chunk).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if k[-1] != "sum"})


def test_campaign(spark):
    rng = random.Random(9)
    sizes = {"long": 60, "short": 10}
    df = spark.createDataFrame([(s, i, rng.random()) for s, n in sizes.items() for i in range(n)], "series_id string, pos int, value double")
    cells = (G.Cell("K_sens", 1.0, 3, 5), G.Cell("K_sens", 1.0, 9, 5), G.Cell("L_sens", 1.0, 3, 12), G.Cell("k_sens", 2.0, 4, 4))
    found = G.campaign(df, cells).collect()
    for c in cells:
        want = [(r.series_id, r["rank"], r.ranks, round(r.support, 9)) for r in mining.top_k_one_pass(df, c.topk, 2, c.maxlen, times=c.factor).collect() if sizes[r.series_id] >= c.maxlen]
        got = [(r.series_id, r["rank"], r.ranks, round(r.support, 9)) for r in found if (r.phase, r.factor, r.topk, r.maxlen) == c]
        assert sorted(got) == sorted(want)
    assert {c.topk for c in G.CAMPAIGN if c.phase == "K_sens"} == {10, 50, 100, 500} and {c.maxlen for c in G.CAMPAIGN} == {8, 12, 16}


def test_run_statistics(spark):
    rows = [("a", "x", v) for v in (1.0, 2.0, 4.0, 9.0)] + [("a", "y", 2.0), ("a", "y", 4.0), ("b", "x", 5.0)]
    runs = spark.createDataFrame(rows, "dataset string, mode string, runtime_ms double")
    assert {(r.dataset, r.mode): r.median for r in T.medians(runs).collect()} == {("a", "x"): 3.0, ("a", "y"): 3.0, ("b", "x"): 5.0}
    q = T.quartiles(runs).where("dataset = 'a' AND mode = 'x'").first()
    assert (q.q1, q.q3) == (1.75, 5.25)
    assert [(r.dataset, r.ratio) for r in T.speedups(runs, "x", "y").collect()] == [("a", 1.0)]
    ci = {(r.dataset, r.mode): r for r in T.bootstrap_median(runs, rounds=300).collect()}
    assert ci["a", "x"].lo <= 3.0 <= ci["a", "x"].hi and (ci["b", "x"].lo, ci["b", "x"].hi) == (5.0, 5.0)
    assert T.labels(runs, {"a": "Alpha"}).where("label = 'Alpha'").count() == 6
    shas = spark.createDataFrame([("d", "m1", "s"), ("d", "m2", "s"), ("e", "m1", "s"), ("e", "m2", "t")], "dataset string, mode string, sha256 string")
    assert {r.dataset: r.agree for r in D.agreement(shas).collect()} == {"d": True, "e": False}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATE,VALUE\n\n2020-01-01,1.5\n2020-01-02,.\n2020-01-03\n2020-01-04,nd\n2020-01-05,3\n")
    assert [r.value for r in S.read_dated_csv(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()] == [1.5, 3.0]
    (tmp_path / "b.txt").write_text("# head\n1,2,3,4,5.5\n1;2;3;4;-1\n1;2\n1;2;3;4; 7 ;x\n")
    assert [(r.pos, r.value) for r in S.read_sunspots(spark, str(tmp_path / "b.txt")).orderBy("pos").collect()] == [(0, 5.5), (1, 7.0)]
    (tmp_path / "c.txt").write_text(" 1, 2;3\n -0.0 Infinity\tNaN ,\n")
    values = [r.value for r in S.read_text(spark, str(tmp_path / "c.txt")).orderBy("pos").collect()]
    assert values[:5] == [1.0, 2.0, 3.0, 0.0, float("inf")] and str(values[3]) == "0.0" and values[5] != values[5]
    got = {r.name: r.sha256 for r in S.file_digests(spark, str(tmp_path / "b.txt")).collect()}
    assert got == {"b.txt": hashlib.sha256((tmp_path / "b.txt").read_bytes()).hexdigest()}
    want = spark.createDataFrame([("b.txt", "no"), ("gone.txt", "x")], "name string, want string")
    assert {r.name: r.status for r in S.file_digests(spark, str(tmp_path / "b.txt"), want).collect()} == {"b.txt": "changed", "gone.txt": "missing"}
    last = S.last_by_key(spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, line int, v int"), ["k"], "line")
    assert {r.k: r.v for r in last.collect()} == {"a": 6, "b": 7}
    log = spark.createDataFrame([("central", "d", 5, "tk", 0.1, 5, 2, 4, 1, 1.5, 3, 1, 1, 0, 0, 9, 2.0)], S.RUN_LOG)
    sinks.write_csv(log, str(tmp_path / "log"))
    assert S.read_run_log(spark, str(tmp_path / "log"), "central").collect() == log.collect() and S.read_run_log(spark, str(tmp_path / "log"), "x").count() == 0
    rows = spark.createDataFrame([("d", 5, "tk", 0.1, 5, 4, 1, "(1,2)", 1.25, "s")], S.CANONICAL)
    sinks.write_tsv(rows, str(tmp_path / "can"))
    assert S.read_canonical(spark, str(tmp_path / "can")).collect() == rows.collect()
    assert sinks.markdown(rows.select("mode", "rank")) == "| mode | rank |\n|---|---|\n| tk | 1 |"


def test_series_by_ranges_of_bytes(spark, tmp_path):
    """Every way to cut a file gives the numbers of the whole file."""
    folder = tmp_path / "texts"
    folder.mkdir()
    rng = random.Random(3)
    parts = [" ", ",", ";", "\n", "  ,; ", "\t\r\n", "\x0b"]
    (folder / "a b.txt").write_text(" \n" + "".join(f"{rng.choice(['1', '-0.0', '12345.678', '1e-3', 'NaN', '7' * 40])}{rng.choice(parts)}" for _ in range(60)))
    (folder / "one.txt").write_text("42")
    (folder / "_hidden").write_text("9 9")
    whole = {}
    for r in S.read_text(spark, str(folder)).collect():
        whole.setdefault(r.series_id.rsplit("/", 1)[1].replace("%20", " "), {})[r.pos] = str(r.value)
    for size in (5, 64, 1 << 20):
        got = {}
        for r in N.read_series(spark, str(folder), size).collect():
            got.setdefault(r.series_id.rsplit("/", 1)[1], {})[r.pos] = str(r.value)
        assert got == whole, size
    many = spark.read.format("series").option("range", 20).load(str(folder))
    assert many.select("series_id", "part").distinct().count() > 15
    for bad in (",1 2", "1 x 2", "", " \n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception):
            N.read_series(spark, str(tmp_path / "bad.txt")).collect()
    with pytest.raises(Exception, match="gone"):
        N.read_series(spark, str(tmp_path / "gone.txt")).collect()


def test_digests_of_files_by_blocks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "files"
    folder.mkdir()
    monkeypatch.setattr(S, "BLOCK", 1000)
    for i, size in enumerate((0, 1, 999, 1000, 123_456)):
        (folder / f"{i}.bin").write_bytes(random.Random(i).randbytes(size))
    want = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in folder.iterdir()}
    assert {r.name: r.sha256 for r in S.file_digests(spark, str(folder)).collect()} == want
    known = spark.createDataFrame(list(want.items()), "name string, want string")
    assert {r.status for r in S.verified(S.file_digests(spark, str(folder), known)).collect()} == {"ok"}
    for bad in ([("gone.bin", "x")], [("1.bin", "x")]):
        wrong = spark.createDataFrame(bad, "name string, want string")
        with pytest.raises(Exception, match="is missing|is changed"):
            S.verified(S.file_digests(spark, str(folder), wrong)).collect()


def _feed(spark, folder, parts):
    """A folder of one file a part, whose times tell their order."""
    folder.mkdir()
    for i, rows in enumerate(parts):
        own = folder.parent / f"{folder.name}-{i}"
        spark.createDataFrame(rows, "series_id string, seq int, value double").coalesce(1).write.parquet(str(own))
        shutil.copy(next(own.glob("*.parquet")), folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    return spark.readStream.schema("series_id string, seq int, value double").option("maxFilesPerTrigger", 1).parquet(str(folder))


def _run(stream, name):
    q = recency.stream_supports(stream, 0.1).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream(spark, tmp_path):
    t = [15, 32, 29, 27, 34, 33, 25, 20, 28, 23]
    rows = [("a", i, float(v)) for i, v in enumerate(t)]
    _run(_feed(spark, tmp_path / "feed", [rows[:4], rows[4:]]), "recency")
    df = spark.createDataFrame([("a", p, float(v)) for p, v in enumerate(t)], "series_id string, pos int, value double")
    want = {r.pattern: r.support for r in mining.top_k_one_pass(df, 100, 2, 4, 0.1).collect()}
    newest = {r.pattern: r for r in spark.table("recency").orderBy("pos").collect()}
    for name, r in newest.items():
        if r.pos == 9:
            assert r.support == pytest.approx(want[name])
    assert sum(r.pos == 9 for r in newest.values()) >= 5


def test_stream_out_of_order(spark, tmp_path):
    rows = [("a", i, float(v)) for i, v in enumerate([15, 32, 29, 27])]
    with pytest.raises(Exception, match="out of order"):
        _run(_feed(spark, tmp_path / "late", [rows[2:], rows[:2]]), "late")
    with pytest.raises(Exception, match="out of order"):
        _run(_feed(spark, tmp_path / "twice", [[*rows, rows[1]]]), "twice")


def test_stream_of_late_values(spark, tmp_path):
    """Values that come out of order, within the watermark's delay, give the answer of the batch; those behind it are dropped."""
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    t = [15, 32, 29, 27, 34, 33, 25, 20, 28, 23, 31, 30, 22, 35]
    rows = [(s, start + datetime.timedelta(seconds=i // 2), i, float(v) + shift) for i, v in enumerate(t) for s, shift in (("a", 0.0), ("b", 0.25 * i))]
    mixed = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 5))
    end = start + datetime.timedelta(hours=1)
    folder = tmp_path / "in-time"
    folder.mkdir()
    schema = "series_id string, ts timestamp, seq long, value double"
    parts = [mixed[:9], mixed[9:15], mixed[15:], [("c", end, 0, 1.0)], [("c", end + datetime.timedelta(hours=1), 1, 2.0)], [("a", start, 99, 1000.0)]]
    for i, part in enumerate(parts):
        own = tmp_path / f"in-time-{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(own))
        shutil.copy(next(own.glob("*.parquet")), folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", "10 seconds")
    q = recency.stream_supports_in_time(stream, 0.1).writeStream.outputMode("update").format("memory").queryName("in_time").trigger(availableNow=True).start()
    q.awaitTermination(180)
    df = spark.createDataFrame([(s, i, v) for s, _, i, v in rows], "series_id string, pos int, value double")
    want = {(r.series_id, r.pattern): r.support for r in mining.top_k_one_pass(df, 1000, 2, 4, 0.1).collect()}
    newest = {}
    for r in spark.table("in_time").collect():
        if r.pos >= newest.get((r.series_id, r.pattern), (-1, 0))[0]:
            newest[r.series_id, r.pattern] = (r.pos, r.support)
    assert set(newest) - {x for x in newest if x[0] == "c"} == set(want)
    for x, (pos, s) in newest.items():
        if x[0] != "c":
            assert s * math.exp(-0.1 * (len(t) - 1 - pos)) == pytest.approx(want[x])
