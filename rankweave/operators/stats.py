"""Statistics of run logs (dataset, mode, runtime_ms and counters)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import dense


def medians(runs: DataFrame, keys: Sequence[str] = ("dataset", "mode"), value: str = "runtime_ms") -> DataFrame:
    """Exact interpolated median of each group."""
    return runs.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"))


def quartiles(runs: DataFrame, keys: Sequence[str] = ("dataset", "mode"), value: str = "runtime_ms") -> DataFrame:
    """Inclusive quartiles."""
    return runs.groupBy(*keys).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))


def geomean(value: Column) -> Column:
    return F.exp(F.avg(F.ln(value)))


def speedups(runs: DataFrame, slow: str, fast: str, value: str = "runtime_ms") -> DataFrame:
    """Ratio of the two modes' medians for each dataset that has both."""
    m = runs.where(F.col("mode").isin(slow, fast)).groupBy("dataset").agg(F.percentile(F.when(F.col("mode") == slow, F.col(value)), 0.5).alias("slow"), F.percentile(F.when(F.col("mode") == fast, F.col(value)), 0.5).alias("fast"))
    return m.where("slow IS NOT NULL AND fast IS NOT NULL").withColumn("ratio", F.col("slow") / F.col("fast"))


def wins(ratios: DataFrame) -> DataFrame:
    return ratios.agg(F.count_if(F.col("ratio") > 1).alias("wins"), F.count(F.lit(1)).alias("datasets"))


def wilcoxon(diffs: DataFrame, value: str = "diff") -> DataFrame:
    """One row: m, w_plus and the exact two-sided p of the signed-rank test.

    Zeros go, and equal sizes share the mean of their ranks. Sizes are counted before they meet in one row; there the
    distribution of the rank sum grows rank by rank, over doubled ranks, which are whole: m^3 steps in place of 2^m
    signs, so any number of differences is taken, and some hundreds are quick.
    """
    x = diffs.where((F.col(value) != 0) & F.col(value).isNotNull()).groupBy(F.abs(value).alias("size"))
    sizes = x.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col(value) > 0).alias("plus"))
    r = sizes.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("int").alias("m"), F.array_sort(F.collect_list(F.struct("size", "k", "plus"))).alias("sizes")).where("m > 0")
    none = F.struct(F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("plus"), F.array().cast("array<bigint>").alias("ranks"))

    def ranked(state: Column, s: Column) -> Column:
        rank = 2 * state["below"] + s["k"] + 1  # twice the mean rank of the k equal sizes
        return F.struct((state["below"] + s["k"]).alias("below"), (state["plus"] + rank * s["plus"]).alias("plus"), F.concat(state["ranks"], F.array_repeat(rank, s["k"].cast("int"))).alias("ranks"))

    r = r.select("m", F.aggregate("sizes", none, ranked).alias("r")).select("m", "r.ranks", F.col("r.plus").alias("plus"))
    grown = lambda p, d: F.transform(F.sequence(F.lit(0).cast("long"), F.size(p) - 1 + d), lambda s: (F.coalesce(F.get(p, s.cast("int")), F.lit(0.0)) + F.when(s >= d, F.get(p, (s - d).cast("int"))).otherwise(0.0)) / 2)
    r = r.withColumn("p", F.aggregate("ranks", F.array(F.lit(1.0)), grown))
    add = lambda part: F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
    low, high = add(F.slice("p", F.lit(1), F.col("plus").cast("int") + 1)), add(F.slice("p", F.col("plus").cast("int") + 1, F.size("p")))
    return r.select("m", (F.col("plus") / 2).alias("w_plus"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"))


def _median_places(n: int, h: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Places, from 0, of the two middle values (equal for odd n) of resamples of n values: of n uniform draws the h-th smallest is beta distributed, and the next is the least of the n - h that are above it."""
    u = rng.beta(h, n - h + 1, rounds)
    v = u if n % 2 else 1 - (1 - u) * rng.random(rounds) ** (1 / (n - h))
    return np.minimum(np.stack([u, v]) * n, n - 1).astype(np.int64)


def bootstrap_median(runs: DataFrame, keys: Sequence[str] = ("dataset", "mode"), value: str = "runtime_ms", rounds: int = 10_000, seed: int = 20_260_907) -> DataFrame:
    """Median and its 95 % interval from ``rounds`` resamples, the same on every run.

    A resample's median is a value, or the mean of two, whose places among the sorted values follow from the law of
    order statistics, so no resample is made: places are drawn, and looked up in the values, which get theirs
    by ranges. No group's values meet in one task.
    """
    keys = list(keys)
    known = runs.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    placed = dense(known, keys, ["__x"]).withColumnRenamed("pos", "__at")
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile("__x", 0.5).alias("median"))

    @F.pandas_udf("array<struct<a bigint,b bigint>>")
    def drawn(n: pd.Series, own: pd.Series) -> pd.Series:
        each = (_median_places(int(k), (int(k) + 1) // 2, np.random.default_rng([seed, int(o) & (1 << 64) - 1]), rounds) for k, o in zip(n, own, strict=True))
        return pd.Series([[{"a": int(a), "b": int(b)} for a, b in zip(*p, strict=True)] for p in each])

    draws = sizes.select(*keys, F.posexplode(drawn("__n", F.xxhash64(*keys))).alias("__round", "__p"))
    pairs = draws.select(*keys, F.explode(F.array("__p.a", "__p.b")).alias("__at"), "__round")
    middles = pairs.join(placed, [*keys, "__at"]).groupBy(*keys, "__round").agg(F.avg("__x").alias("__m"))
    ends = middles.groupBy(*keys).agg(F.percentile("__m", 0.025).alias("lo"), F.percentile("__m", 0.975).alias("hi"))
    return sizes.select(*keys, "median").join(ends, keys)


def nearest(points: DataFrame, keys: Sequence[str], at: str, value: str, target: float) -> DataFrame:
    """The value at the point nearest to a target, the lower point if two are."""
    return points.groupBy(*keys).agg(F.min_by(F.struct(F.col(at).alias("place"), F.col(value).alias("value")), F.struct(F.abs(F.col(at) - target), F.col(at))).alias("r")).select(*keys, "r.*")


def labels(df: DataFrame, names: dict[str, str], column: str = "dataset") -> DataFrame:
    """Display names of a column's values; others stay."""
    if not names:
        return df.withColumn("label", F.col(column))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return df.withColumn("label", F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
