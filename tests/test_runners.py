import math
import random

import pytest
from pyspark.sql import functions as F

from rankweave.plans import grid as G
from rankweave.plans import mining as M
from rankweave.plans import runners as U
from rankweave.sources import series as S
from rankweave.sources import sinks
from test_engine import frame

CELL = G.Cell("central", 1.0, 6, 3)


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(12)
    return frame(spark, [[rng.random() for _ in range(40)], [rng.randrange(9) for _ in range(30)], [1.0, 2.0]]).cache()


def test_run_log(spark, some, tmp_path):
    modes = ("hjtopk", "tk-no-pdub", "tk")
    log = U.run_log(some, modes, [CELL], warm=0, repeats=1).cache()
    rows = log.collect()
    assert log.columns == [c.split()[0] for c in S.RUN_LOG.split(", ")]
    # the series of two values is shorter than the cell's patterns
    assert sorted((r.dataset, r.mode, r.rep) for r in rows) == sorted((s, m, i) for s in "01" for m in modes for i in (0,))
    for r in rows:
        assert r.runtime_ms > 0 and r.patterns == 6 and r.k == pytest.approx(1 / r.n) and (r.minlen, r.maxlen, r.topk) == (2, 3, 6)
        assert r.pair_attempts > 0 and r.aligned_checks > 0 and (r.pdub_prunes == 0 or r.mode == "tk")
    assert max(r.peak_heap_mb for r in rows) > 0
    sinks.write_csv(log, str(tmp_path / "log"))
    assert S.read_run_log(spark, str(tmp_path / "log"), "central").count() == len(rows)
    short = U.companion_log(log)
    assert short.columns == [c.split()[0] for c in U.COMPANION.split(", ")] and short.agg(F.max("heap_used_bytes")).first()[0] > 1000


def test_memory_of_a_run_that_spills(spark):
    old = spark.conf.get("spark.sql.windowExec.buffer.spill.threshold", None)
    spark.conf.set("spark.sql.windowExec.buffer.spill.threshold", "2000")
    spark.conf.set("spark.sql.windowExec.buffer.in.memory.threshold", "1000")
    try:
        with U.Measured(spark) as run:
            rows = spark.range(60_000).withColumn("k", F.lit(1))
            assert rows.selectExpr("sum(id) OVER (PARTITION BY k) AS s").distinct().count() == 1
        assert run.memory.spilled > 0 and run.memory.peak > 0 and run.ms > 0
        with U.Measured(spark) as other:
            spark.range(10).count()
        assert other.memory.spilled == 0
    finally:
        spark.conf.unset("spark.sql.windowExec.buffer.in.memory.threshold")
        spark.conf.unset("spark.sql.windowExec.buffer.spill.threshold") if old is None else spark.conf.set("spark.sql.windowExec.buffer.spill.threshold", old)


def test_canonical_and_ablation(spark, some, tmp_path):
    own = some.where("series_id <> '2'")
    rows = U.canonical(own, ("hjtopk", "tk"), CELL)
    sinks.write_tsv(rows, str(tmp_path / "canonical"))
    back = S.read_canonical(spark, str(tmp_path / "canonical")).collect()
    assert len(back) == 2 * 2 * 6 and len({(r.dataset, r.sha256) for r in back}) == 2
    got = {(r.dataset, r.mode): r for r in U.ablation(own, CELL).collect()}
    assert set(got) == {(s, m) for s in "01" for m in U.ABLATION} and {r.npat for r in got.values()} == {6}
    for s in "01":
        assert {got[s, m].sha256 for m in U.ABLATION} == {next(r.sha256 for r in back if r.dataset == s)}
        assert got[s, "tk"].aligned == got[s, "tk-naive"].aligned and got[s, "tk-no-pdub"].pdub_prunes == 0


def test_answers_that_differ_are_an_error(some, monkeypatch):
    plain = M.top_k_one_pass
    monkeypatch.setattr(M, "top_k_one_pass", lambda series, topk, *a, **b: plain(series, topk - 1, *a, **b))
    with pytest.raises(ValueError, match="different answers"):
        U.canonical(some.where("series_id = '0'"), ("hjtopk", "tk"), CELL)


def test_threshold_counters(some):
    """Of searches with and without an index: attempts differ, answers and other counters don't."""
    fast, slow = (M.search(some, mode, min_sup=0.8, max_len=4, k=0.1) for mode in ("hj", "baseline"))
    a, b = ({r.series_id: r for r in x.counters.collect()} for x in (fast, slow))
    top = {}
    for r in fast.top.collect():
        top.setdefault((r.series_id, r.m), set()).add(tuple(r.ranks))
    for s in a:
        frontier = [len(top.get((s, m), ())) for m in (2, 3)]
        assert a[s].pair_attempts == sum(frontier) and b[s].pair_attempts == sum(f * f for f in frontier)
        assert a[s].expanded_patterns == sum(len(v) for (i, m), v in top.items() if i == s and m > 2)
        assert a[s].aligned_checks == b[s].aligned_checks and a[s].generated_patterns >= a[s].expanded_patterns
    assert sorted(map(str, fast.top.collect())) == sorted(map(str, slow.top.collect()))


def test_benchmark_properties(spark, tmp_path):
    (tmp_path / "b.properties").write_text("# a comment\ndatasets = a.txt, b.txt\nmodes=hj,\\\ntk\nwarmups:0\nrepeats 1\n! more\ntopk=3\nmaxlen=4\nforgetting=0.1\nother=1\n")
    b = U.read_benchmark(str(tmp_path / "b.properties"))
    assert (b.datasets, b.modes, b.warmups, b.repeats, b.topk, b.maxlen, b.minlen, b.minsup) == (["a.txt", "b.txt"], ["hj", "tk"], 0, 1, 3, 4, 2, 1.5)
    rng = random.Random(1)
    rows = sorted(U.benchmark(frame(spark, [[rng.random() for _ in range(20)]]), b).collect(), key=lambda r: r.mode)
    assert [(r.mode, r.run) for r in rows] == [("hj", 0), ("tk", 0)] and rows[0].minsup == 1.5 and rows[1].patterns == 3 and math.isclose(rows[1].k, 0.1)
    (tmp_path / "none.properties").write_text("modes=tk\n")
    with pytest.raises(ValueError):
        U.read_benchmark(str(tmp_path / "none.properties"))


def test_environment(spark):
    lines = dict(x.split("=", 1) for x in U.environment(spark, warmups=5, modes=U.FIVE).splitlines())
    assert lines["warmups"] == "5" and lines["modes"].split(",") == list(U.FIVE) and lines["java.version"] and int(lines["maxMemoryMB"]) > 0


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from rankweave import __main__ as cli

    rng = random.Random(3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(" ".join(str(rng.random()) for _ in range(25)))
    assert cli.main(["--input", str(tmp_path / "in" / "a.txt"), "--topK", "3", "--maxLen", "3"]) == 0
    lines = [x for x in capsys.readouterr().out.splitlines() if "\t" in x]
    assert [x.split("\t")[0] for x in lines] == ["1", "2", "3"]
    monkeypatch.setattr(U, "CENTRAL", CELL)
    monkeypatch.setattr(U, "PUBLIC", ("hjtopk", "tk"))
    for f in (U.canonical, U.run_log):
        monkeypatch.setattr(f, "__defaults__", tuple(CELL if d == G.Cell("central", 1.0, 50, 12) else (CELL,) if d == (G.Cell("central", 1.0, 50, 12),) else d for d in f.__defaults__))
    assert cli.main(["--input", str(tmp_path / "in"), "--run", "public", "--output", str(tmp_path / "out"), "--warmups", "0", "--repeats", "1"]) == 0
    assert {(r.dataset, r.mode) for r in S.read_run_log(spark, str(tmp_path / "out" / "runs"), "public").collect()} == {("a.txt", "hjtopk"), ("a.txt", "tk")}
    assert S.read_canonical(spark, str(tmp_path / "out" / "canonical")).count() == 12
    assert any(r.value.startswith("spark.version=") for r in spark.read.text(str(tmp_path / "out" / "environment")).collect())
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "b.properties").write_text("datasets=in/a.txt\nmodes=hj\nwarmups=0\nrepeats=1\nmaxlen=3\n")
    assert cli.main(["--input", str(tmp_path / "conf" / "b.properties"), "--run", "benchmark", "--output", str(tmp_path / "out")]) == 0
    assert [r["dataset"] for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "benchmark")).collect()] == ["a.txt"]
