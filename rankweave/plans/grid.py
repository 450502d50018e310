"""Answers of many cells, of forgetting factor, number and length of patterns, from one search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import factorial
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ranks as R
from ..operators import windows as X
from ..operators.scratch import counted, if_few


class Cell(NamedTuple):
    phase: str
    factor: float  # times 1 / n
    topk: int
    maxlen: int


#: The campaign's cells.
CAMPAIGN = (
    Cell("central", 1.0, 50, 12),
    *(Cell("K_sens", 1.0, k, 12) for k in (10, 50, 100, 500)),
    *(Cell("L_sens", 1.0, 50, m) for m in (8, 12, 16)),
    *(Cell("k_sens", f, 50, 12) for f in (0.25, 0.5, 1.0, 2.0, 4.0)),
)


def grid_supports(occurred: DataFrame, factors: Sequence[float]) -> DataFrame:
    """n_occ and, of each pattern, its supports under all ``factors``: one aggregation, partial sums first."""
    w = [R.exact_sum(R.weight(F.col("pos"), F.col("n"), X.decay(None, f))).alias(f"s{i}") for i, f in enumerate(factors)]
    sums = occurred.groupBy("series_id", "n", "m", "ranks").agg(F.count(F.lit(1)).alias("n_occ"), *w)
    return sums.select("series_id", "n", "m", "ranks", "n_occ", F.array(*(f"s{i}" for i in range(len(factors)))).alias("supports"))


def grid_patterns(series: DataFrame, factors: Sequence[float], topk: Sequence[int], min_len: int, max_len: int) -> DataFrame:
    """``grid_supports`` of all patterns that can be among the ``topk`` first of a series under some factor.

    The shortest patterns, of lengths that may give enough of them, are found in one pass. A longer one ends where its
    part without the first value ends, so it has at most that part's support: each further pass, of one length, takes
    the windows whose part is at its factor's k-th support so far or above it, and the passes end when no part is.
    """
    m = min_len
    while m < max_len and sum(factorial(x) for x in range(min_len, m + 1)) < max(topk):
        m += 1
    found, size = counted(grid_supports(X.occurrences(series, min_len, m), factors), "grid")
    levels = [found]
    while size["rows"] and m < max_len:
        every = reduce(DataFrame.unionByName, levels)
        by = W.Window.partitionBy("series_id", "i").orderBy(F.desc("support"))
        each = every.select("series_id", F.posexplode("supports").alias("i", "support")).withColumn("place", F.row_number().over(by)).where(F.col("place") <= max(topk))
        thetas = each.groupBy("series_id").agg(*(F.max(F.when((F.col("i") == i) & (F.col("place") == k), F.col("support"))).alias(f"t{i}") for i, k in enumerate(topk)))
        above = reduce(lambda a, b: a | b, (F.col(f"t{i}").isNull() | (F.get("supports", F.lit(i)) >= F.col(f"t{i}")) for i in range(len(factors))))
        alive, size = counted(found.join(thetas, "series_id").where(above).select("series_id", F.col("ranks").alias("part")), "alive")
        if not size["rows"]:
            break
        m += 1
        parts = X.windows(series, m, m).withColumn("part", R.rank_encode(F.slice("win", 2, m - 1))).join(if_few(alive, size["rows"]), ["series_id", "part"], "left_semi")
        occurred = parts.select("series_id", "pos", "n", "m", R.rank_encode(F.col("win")).alias("ranks")).where("ranks IS NOT NULL")
        found, size = counted(grid_supports(occurred, factors), "grid")
        levels.append(found)
    return reduce(DataFrame.unionByName, levels)


def campaign(series: DataFrame, cells: Sequence[Cell] = CAMPAIGN, min_len: int = 2) -> DataFrame:
    """phase, factor, topk, maxlen and the ranked patterns of every cell whose length limit the series has room for.

    Cells that differ in topk alone share a ranking, and a pattern is ranked once for each (factor, maxlen).
    """
    factors = sorted({c.factor for c in cells})
    rankings = sorted({(c.factor, c.maxlen) for c in cells})
    most = {r: max(c.topk for c in cells if (c.factor, c.maxlen) == r) for r in rankings}
    topk = [max(c.topk for c in cells if c.factor == f) for f in factors]
    found = grid_patterns(series, factors, topk, min_len, max(c.maxlen for c in cells))
    one = lambda i, f, m: F.when((F.col("m") <= m) & (F.col("n") >= m), F.struct(F.lit(i).alias("ranking"), F.get("supports", F.lit(factors.index(f))).alias("support")))
    each = F.explode(F.array_compact(F.array(*(one(i, *r) for i, r in enumerate(rankings)))))
    ranked = found.select("series_id", "n", "m", "ranks", "n_occ", each.alias("r")).select("series_id", "n", "m", "ranks", "n_occ", "r.*")
    by = W.Window.partitionBy("series_id", "ranking").orderBy(F.desc("support"), "m", "ranks")
    ranked = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(most.values()))
    own = lambda c: F.struct(F.lit(c.phase).alias("phase"), F.lit(float(c.factor)).alias("factor"), F.lit(c.topk).cast("long").alias("topk"), F.lit(c.maxlen).cast("long").alias("maxlen"))
    table = F.array(*(F.struct(F.lit(rankings.index((c.factor, c.maxlen))).alias("ranking"), own(c).alias("cell")) for c in cells))
    met = ranked.withColumn("g", F.explode(F.filter(table, lambda g: (g["ranking"] == F.col("ranking")) & (g["cell"]["topk"] >= F.col("rank")))))
    return met.select("series_id", "n", "g.cell.*", "rank", "m", "ranks", "n_occ", "support")
