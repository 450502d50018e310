"""Measured runs: modes, warm-ups and repeats, and their run logs, canonical rows and environment.

All series of a frame are run together, and each gets its rows. A run's time is that of its answer, written
to the shared folder; the number of patterns is observed in that write, and memory is read from the metrics
that Spark keeps of the run's stages, told by a job group. Counters are those of the search that visits pairs in order.
"""

from __future__ import annotations

import platform
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest as D
from ..operators.scratch import counted, stored
from ..operators.windows import sized
from ..sources import series as S
from ..sources import sinks
from . import mining as M
from .grid import CAMPAIGN, Cell

FIVE = ("hjtopk", "tk-no-bounds", "tk-no-pdub", "tk-no-dub", "tk")
PUBLIC = ("hjtopk", "tk-no-pdub", "tk")
ABLATION = ("tk-no-pdub", "tk-naive", "tk")
CENTRAL = Cell("central", 1.0, 50, 12)

#: The run log of the single-file program.
COMPANION = "dataset string, mode string, k double, topk int, minlen int, maxlen int, rep int, runtime_ms double, pair_attempts bigint, compatible_pairs bigint, pdub_prunes bigint, dub_prunes bigint, aligned_checks bigint, heap_used_bytes bigint"


@dataclass
class Memory:
    """Of a run's stages: the greatest sum of its tasks' peaks, and the bytes spilled to disk."""

    peak: int = 0
    spilled: int = 0


class Measured:
    """Times what runs inside, and reads its stages' memory from Spark's metrics."""

    def __init__(self, spark: SparkSession):
        self.context, self.group, self.memory = spark.sparkContext, f"rankweave-{uuid.uuid4().hex}", Memory()

    def __enter__(self) -> Measured:
        self.context.setJobGroup(self.group, "measured run")
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.ms = (time.perf_counter() - self.began) * 1000
        self.context._jsc.clearJobGroup()
        jsc = self.context._jsc.sc()
        jsc.listenerBus().waitUntilEmpty(10_000)
        store = jsc.statusStore()
        for job in self.context.statusTracker().getJobIdsForGroup(self.group):
            info = self.context.statusTracker().getJobInfo(job)
            for stage in info.stageIds if info else ():
                try:
                    seen = store.lastStageAttempt(stage)
                except Exception:  # a stage that was skipped, or is kept no longer
                    continue
                self.memory.peak = max(self.memory.peak, seen.peakExecutionMemory())
                self.memory.spilled += seen.diskBytesSpilled()


def _answer(series: DataFrame, mode: str, cell: Cell, min_len: int, min_sup: float, k: float | None) -> DataFrame:
    if k is not None or mode in ("hj", "baseline"):
        return M.mine(series, mode, cell.topk, min_sup, min_len, cell.maxlen, k)
    if mode in ("hjtopk", "bruteforce"):
        return M.top_k_one_pass(series, cell.topk, min_len, cell.maxlen, times=cell.factor)
    return M.top_k_pruned(series, cell.topk, min_len, cell.maxlen, times=cell.factor, **M.MODES[M.ALIASES.get(mode, mode)]).top


def run_log(series: DataFrame, modes: Sequence[str], cells: Sequence[Cell] = (CENTRAL,), warm: int = 5, repeats: int = 10, min_len: int = 2, min_sup: float = 1.5, k: float | None = None) -> DataFrame:
    """Rows of ``sources.series.RUN_LOG`` for every series, mode, cell and repeat; cells longer than a series give it none."""
    spark = series.sparkSession
    series = stored(series, "series")
    sizes = stored(sized(series).groupBy("series_id").agg(F.max("n").alias("n")), "sizes")
    log = spark.createDataFrame([], S.RUN_LOG)
    for cell in cells:
        fits = sizes.where(F.col("n") >= cell.maxlen)
        own = series.join(F.broadcast(fits.select("series_id")), "series_id", "left_semi")
        for mode in modes:
            counters = stored(M.search(own, mode, cell.topk, min_sup, min_len, cell.maxlen, k, cell.factor).counters, "counters")
            for rep in range(-warm, repeats):
                with Measured(spark) as run:
                    answer, _ = counted(_answer(own, mode, cell, min_len, min_sup, k), "answer")
                if rep < 0:
                    continue
                rows = fits.join(answer.groupBy("series_id").agg(F.count(F.lit(1)).alias("patterns")), "series_id", "left").join(counters, "series_id", "left")
                values = {
                    "phase": F.lit(cell.phase), "dataset": F.col("series_id"), "n": F.col("n"), "mode": F.lit(mode), "k": F.lit(k) if k is not None else cell.factor / F.col("n"), "topk": F.lit(cell.topk),
                    "minlen": F.lit(min_len), "maxlen": F.lit(cell.maxlen), "rep": F.lit(rep), "runtime_ms": F.lit(run.ms), "peak_heap_mb": F.lit(run.memory.peak / (1 << 20)),
                }
                schema = log.schema
                log = log.unionByName(rows.select(*(values.get(f.name, F.coalesce(F.col(f.name) if f.name not in values else F.lit(None), F.lit(0))).cast(f.dataType).alias(f.name) for f in schema)))
    return stored(log, "runs")


def companion_log(runs: DataFrame) -> DataFrame:
    """A run log in the 14 columns of the single-file program, with the memory in bytes."""
    wide = runs.withColumn("heap_used_bytes", (F.col("peak_heap_mb") * (1 << 20)).cast("long"))
    return wide.select(*(c.split()[0] for c in COMPANION.split(", ")))


def canonical(series: DataFrame, modes: Sequence[str] = FIVE, cell: Cell = CENTRAL, min_len: int = 2) -> DataFrame:
    """Canonical rows of every series and mode, untimed; answers that differ between modes are an error."""
    out = None
    for mode in modes:
        mode = M.ALIASES.get(mode, mode)
        # supports are added in the order of ends, as the digests need
        if mode in ("hjtopk", "bruteforce"):
            answer = M.top_k_one_pass(series, cell.topk, min_len, cell.maxlen, times=cell.factor, ends=True)
        else:
            answer = M.top_k_pruned(series, cell.topk, min_len, cell.maxlen, times=cell.factor, **M.MODES[mode]).top
            answer = D.ordered_supports(answer, series, cell.factor)
        answer = stored(answer, "answer")
        rows = sinks.canonical(answer, D.digests(answer).select("series_id", "sha256"), mode, 0.0, cell.topk, cell.maxlen).withColumn("k", cell.factor / F.col("n"))
        out = rows if out is None else out.unionByName(rows)
    out = stored(out, "canonical")
    differing = D.agreement(out.select("dataset", "mode", "sha256").distinct()).where("NOT agree").limit(5).collect()
    if differing:
        raise ValueError(f"modes have different answers: {[r.dataset for r in differing]}")
    return out


def ablation(series: DataFrame, cell: Cell = CENTRAL, modes: Sequence[str] = ABLATION) -> DataFrame:
    """Rows of ``sources.series.ABLATION``; an error if the answers, or the search trees with and without profiles, differ."""
    series = stored(series, "series")
    digests = canonical(series, modes, cell).groupBy("dataset", "mode").agg(F.first("sha256").alias("sha256"), F.count(F.lit(1)).alias("npat"))
    out = None
    for mode in modes:
        c = M.search(series, mode, cell.topk, max_len=cell.maxlen, times=cell.factor).counters
        c = c.select(F.col("series_id").alias("dataset"), F.lit(mode).alias("mode"), F.col("aligned_checks").alias("aligned"), "pdub_prunes", "dub_prunes")
        out = c if out is None else out.unionByName(c)
    out = stored(digests.join(out, ["dataset", "mode"]).select("dataset", "mode", "sha256", "npat", "aligned", "pdub_prunes", "dub_prunes"), "ablation")
    if (other := D.same_search(out.where(F.col("mode").isin("tk", "tk-naive"))).where("NOT same").limit(5).collect()):
        raise ValueError(f"search trees differ: {[r.dataset for r in other]}")
    return out


@dataclass
class Benchmark:
    """Settings of a benchmark, as a properties file names them."""

    datasets: list[str]
    modes: list[str] = field(default_factory=lambda: ["baseline", "hj", "hjtopk", "tk", "tk-no-pdub", "tk-no-dub", "tk-no-bounds"])
    warmups: int = 3
    repeats: int = 10
    forgetting: float = 0.1
    minsup: float = 1.5
    topk: int = 5
    minlen: int = 2
    maxlen: int = 0
    output: str = "results/benchmark"


def read_properties(text: str) -> dict[str, str]:
    """Keys and values of a properties file: key, then =, : or a blank, then the value; # and ! begin comments."""
    out = {}
    for line in text.replace("\\\n", "").splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        cut = min((i for i in (line.find(c) for c in "=: \t") if i >= 0), default=len(line))
        out[line[:cut].strip()] = line[cut:].lstrip(" \t").removeprefix("=").removeprefix(":").strip()
    return out


def read_benchmark(path: str) -> Benchmark:
    given = read_properties(Path(path).read_text(encoding="utf-8"))
    if "datasets" not in given:
        raise ValueError("a benchmark names its datasets")
    kinds = {f.name: f.type for f in fields(Benchmark)}
    plain = {"int": int, "float": float, "str": str}
    return Benchmark(**{n: plain[kinds[n]](v) if kinds[n] in plain else [x.strip() for x in v.split(",")] for n, v in given.items() if n in kinds})


def benchmark(series: DataFrame, b: Benchmark) -> DataFrame:
    """A benchmark's log: dataset, mode, run, n, k, minsup and so on."""
    longest = series.agg((F.max("pos") + 1).alias("n")).first().n or 0
    cells = [Cell("benchmark", 1.0, b.topk, b.maxlen if b.maxlen > 0 else longest)]
    runs = run_log(series, b.modes, cells, b.warmups, b.repeats, b.minlen, b.minsup, b.forgetting)
    names = {"rep": "run", "pdub_prunes": "pair_desc_prunes", "dub_prunes": "branch_prunes"}
    columns = ["dataset", "mode", "rep", "n", "k", "minsup", "topk", "minlen", "maxlen", "runtime_ms", "patterns", "pair_attempts", "compatible_pairs", "pdub_prunes", "dub_prunes", "aligned_checks", "peak_heap_mb"]
    return runs.withColumn("minsup", F.lit(b.minsup)).select(*(F.col(c).alias(names.get(c, c)) for c in columns))


def environment(spark: SparkSession, **more: object) -> str:
    """Lines key=value of versions, cores and memory, and of what else is given."""
    system = spark.sparkContext._jvm.java.lang.System.getProperty
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    rows = {
        "java.version": system("java.version"), "java.vendor": system("java.vendor"), "os.name": system("os.name"), "os.arch": system("os.arch"), "os.version": system("os.version"), "spark.version": spark.version,
        "python.version": platform.python_version(), "spark.master": spark.sparkContext.master, "defaultParallelism": spark.sparkContext.defaultParallelism, "maxMemoryMB": runtime.maxMemory() >> 20,
    } | more
    return "".join(f"{k}={','.join(map(str, v)) if isinstance(v, Iterable) and not isinstance(v, str) else v}\n" for k, v in rows.items())


def campaign(series: DataFrame, cells: Sequence[Cell] = CAMPAIGN, modes: Sequence[str] = FIVE, warm: int = 5, repeats: int = 10) -> DataFrame:
    """The run log of a campaign; sweeps have at most 3 warm-ups and 5 repeats."""
    central = [c for c in cells if c.phase == "central"]
    sweeps = [c for c in cells if c.phase != "central"]
    return run_log(series, modes, central, warm, repeats).unionByName(run_log(series, modes, sweeps, min(3, warm), min(5, repeats)))
