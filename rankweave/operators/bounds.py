"""Upper bounds on the support of a pattern's right extensions.

UB_d bounds an extension by d values: its ends lie d later, so each weight is e^(k d) times that of an
end no later than n - 1 - d. The bounds are sums of one pass over the occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks as R
from .windows import decay

EPS = 1e-12
#: Depths that have a bound each; all beyond share one.
DENSE = 48


def profiles(occurred: DataFrame, depth: int, k: float | None = None, times: float = 1.0) -> DataFrame:
    """Every pattern with n_occ, support and ub, the array UB_0..UB_depth.

    Beyond DENSE depths, ub is UB_0..UB_(DENSE - 1) and twice a bound of all depths from DENSE to ``depth``; twice, so
    that ``pdub`` holds it against the last single depth and against itself. The rest is cut into steps that grow by
    an eighth, and a step has its first depth's sum and its last depth's factor, so the sums grow with the logarithm
    of ``depth``.
    """
    single = depth + 1 if depth < 2 * DENSE else DENSE
    starts = [*range(single)]
    while single <= depth and starts[-1] + max(1, starts[-1] // 8) <= depth:
        starts.append(starts[-1] + max(1, starts[-1] // 8) if len(starts) > single else single)
    lasts = [*starts[:single], *(x - 1 for x in starts[single + 1 :]), *([depth] if len(starts) > single else [])]
    factor = decay(k, times)
    x = occurred.withColumns({"k": factor, "w": R.weight(F.col("pos"), F.col("n"), factor)})
    sums = [R.exact_sum(F.when(F.col("pos") <= F.col("n") - 1 - d, F.col("w"))).alias(f"s{d}") for d in starts]
    g = x.groupBy("series_id", "n", "k", "m", "ranks").agg(F.count(F.lit(1)).alias("n_occ"), *sums)
    bound = [F.when(F.col("n") - 1 - d < 0, 0.0).otherwise(F.exp(F.col("k") * F.least(F.lit(e), F.col("n") - 1)) * F.col(f"s{d}")) for d, e in zip(starts, lasts, strict=True)]
    rest = [F.greatest(*bound[single:], F.lit(0.0))] * 2 if len(starts) > single else []
    ub = F.array(*bound[:single], *rest)
    return g.select("series_id", "n", "k", "m", "ranks", "n_occ", F.col("s0").alias("support"), ub.alias("ub"))


def depth_bounds(profiled: DataFrame) -> DataFrame:
    """One row per pattern and depth."""
    return profiled.select("series_id", "m", "ranks", F.posexplode("ub").alias("d", "bound"))


def dub(ub: Column) -> Column:
    """Bound of all extensions to the profile's depth."""
    return F.array_max(ub)


def pdub(ub_p: Column, ub_q: Column) -> Column:
    """Bound of a pair's child and its extensions: p one step earlier, q at the same step; 0 without depth."""
    later = F.slice(ub_p, 2, F.greatest(F.size(ub_p) - 1, F.lit(0)))
    return F.coalesce(F.array_max(F.zip_with(later, F.slice(ub_q, 1, F.size(later)), lambda a, b: F.least(a, b))), F.lit(0.0))


def pair_ub(support_p: Column, support_q: Column, k: Column) -> Column:
    """Bound of the immediate child alone; its extensions can exceed it, so it is no ground for pruning."""
    return F.least(F.exp(k) * support_p, support_q)


def below(bound: Column, least: Column) -> Column:
    """True if a bound rules out; equality doesn't, so tie-breaks live."""
    return bound + EPS < least


def safe_less(bound: Column, least: Column) -> Column:
    """As below, with room for 32 units in the last place of the larger side."""
    scale = F.greatest(F.lit(1.0), F.abs(bound), F.abs(least))
    return bound + F.greatest(F.lit(EPS), scale * 7.2e-15) < least
