"""Query plans: one pass over all windows, level-wise search with bounds, and level-wise thresholds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..operators import bounds as B
from ..operators import joins as J
from ..operators import windows as X
from ..operators.scratch import FEW, counted, if_few, stored

COLUMNS = ["series_id", "n", "m", "ranks", "n_occ", "support"]


def _checked(series: DataFrame, topk: int, min_len: int, max_len: int) -> int:
    """The length limit; 0 stands for the longest series."""
    if topk <= 0:
        raise ValueError("the number of patterns must be above 0")
    if min_len < 2:
        raise ValueError("patterns have at least 2 values")
    longest = series.agg((F.max("pos") + 1).alias("n")).first().n or 0 if max_len <= 0 else max_len
    if max_len > 0 and max_len < min_len or max_len <= 0 and 0 < longest < min_len:
        raise ValueError("the least length is above the greatest")
    return max(longest, min_len)


def top_k_one_pass(series: DataFrame, topk: int, min_len: int = 2, max_len: int = 0, k: float | None = None, times: float = 1.0, ends: bool = False) -> DataFrame:
    """Ranked top-k of each series from all windows: shuffles on series chunks, then partial sums by pattern."""
    most = _checked(series, topk, min_len, max_len)
    occurred = X.occurrences(series, min_len, most)
    found = X.pattern_ends(occurred, k, times) if ends else X.pattern_supports(occurred, k, times)
    return X.top_k(found, topk).withColumn("pattern", R.compact(F.col("ranks")))


@dataclass
class Search:
    """What a level-wise search found, and each series' counters."""

    top: DataFrame
    counters: DataFrame


COUNTERS = ("pair_attempts", "compatible_pairs", "pdub_prunes", "dub_prunes", "generated_patterns", "expanded_patterns", "aligned_checks")


def _tally(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """Sums by series of the counters that ``parts`` have."""
    every = spark.createDataFrame([], "series_id string, " + ", ".join(f"{c} bigint" for c in COUNTERS))
    for part in parts:
        every = every.unionByName(part, allowMissingColumns=True)
    return every.groupBy("series_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))


def _pairs(live: DataFrame) -> DataFrame:
    """(series_id, p, q, bound, pruned) of the pairs that ``live``, patterns with ub and theta, fuse to; theta null where there are too few patterns for one."""
    own = live.select("series_id", "ranks", "ub", "theta")
    pairs = J.pair_join(live).join(own.toDF("series_id", "p", "ub_p", "theta"), ["series_id", "p"]).join(own.select("series_id", F.col("ranks").alias("q"), F.col("ub").alias("ub_q")), ["series_id", "q"])
    bound = B.pdub(F.col("ub_p"), F.col("ub_q"))
    return pairs.select("series_id", "p", "q", bound.alias("bound"), F.coalesce(B.below(bound, F.col("theta")), F.lit(False)).alias("pruned"))


def running_thetas(found: DataFrame, top: DataFrame | None, topk: int) -> DataFrame:
    """(series_id, theta, steps) for every series of ``found`` or ``top``: theta before the level, and, in the order of ``visit_key``, the keys of the patterns that raise it or fill the last place, with theta after each.

    Only patterns above theta can; their parents are at most e^k below it, so about (length + 1) * topk of them
    meet in a row.
    """
    held = found.select("series_id").distinct().withColumn("heap", F.array().cast("array<double>"))
    if top is not None:
        heaps = top.groupBy("series_id").agg(F.sort_array(F.collect_list("support"), asc=False).alias("full"))
        held = held.join(heaps, "series_id", "full").select("series_id", F.coalesce("full", F.array().cast("array<double>")).alias("heap"))
    kth = lambda h: F.get(h, F.lit(topk - 1))
    new = found.join(held, "series_id").where(F.coalesce(F.col("support") > kth(F.col("heap")), F.lit(True)))
    new = new.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(R.visit_key(F.col("ranks")).alias("key"), "support"))).alias("new"))
    none = F.array().cast("array<struct<key:array<int>,theta:double>>")

    def offered(state: Column, x: Column) -> Column:
        heap = F.slice(F.sort_array(F.array_append(state["heap"], x["support"]), asc=False), 1, topk)
        return F.struct(heap.alias("heap"), F.array_append(state["steps"], F.struct(x["key"].alias("key"), kth(heap).alias("theta"))).alias("steps"))

    steps = F.aggregate(F.coalesce("new", F.array().cast("array<struct<key:array<int>,support:double>>")), F.struct(F.col("heap"), none.alias("steps")), offered, lambda state: state["steps"])
    return held.join(new, "series_id", "left").select("series_id", kth(F.col("heap")).alias("theta"), steps.alias("steps"))


def _theta_at(key: Column, itself: bool) -> Column:
    """Theta before a place in the order, or after it."""
    passed = F.filter("steps", lambda s: (s["key"] <= key) if itself else (s["key"] < key))
    return F.when(F.size(passed) > 0, F.element_at(passed, -1)["theta"]).otherwise(F.col("theta"))


def top_k_pruned(
    series: DataFrame, topk: int, min_len: int = 2, max_len: int = 0, k: float | None = None, times: float = 1.0, use_pdub: bool = True, use_dub: bool = True, exact: bool = False
) -> Search:
    """Ranked top-k by level-wise search: levels fuse the occurrences of the patterns that may still matter.

    Theta, the k-th support so far, rises once a level. With ``exact``, it rises with every pattern, as in a search
    that visits pairs in order one by one, so prunes and all other counters are that search's; aligned_checks is
    counted then, too. A pruned pair's children can't raise theta, so both find the same answer.
    An occurrence carries its first and last value, and a level costs one exchange of occurrences. Level
    tables go to the shared folder: lineage stays short, and a lost executor costs one level at most.
    """
    most = _checked(series, topk, min_len, max_len)
    spark = series.sparkSession
    level = X.seeds(series).where("ranks IS NOT NULL")
    offers, offered, pairs, tally = [], 0, None, []
    top = lambda: X.top_k(reduce(DataFrame.unionByName, offers), topk) if offers else None
    for m in range(2, most + 1):
        if m < most:
            level = stored(level, "level")
        found, size = counted(B.profiles(level, most - m, k, times), "patterns")
        total = size["rows"]
        if not total and pairs is None:
            break
        if exact and pairs is not None:
            thetas = stored(running_thetas(found if m >= min_len else found.limit(0), top(), topk), "thetas")
            first = F.array_min(F.transform(R.fusions(F.col("p"), F.col("q")), R.visit_key))
            late = pairs.join(thetas, "series_id", "left").withColumn("theta", _theta_at(first, False))
            pairs = stored(late.withColumn("pruned", F.lit(use_pdub) & F.coalesce(B.below(F.col("bound"), F.col("theta")), F.lit(False))).select("series_id", "p", "q", "pruned"), "pairs")
            gone = pairs.where("pruned").select("series_id", "p", "q")
            found = found.withColumns({"p": R.prefix_key(F.col("ranks")), "q": R.suffix_key(F.col("ranks"))}).join(gone, ["series_id", "p", "q"], "left_anti").drop("p", "q")
            found, size = counted(found.join(thetas, "series_id", "left").withColumn("theta", _theta_at(R.visit_key(F.col("ranks")), True)).drop("steps"), "patterns")
            total = size["rows"]
            tally.append(J.aligned_checks(parents, pairs.where("NOT pruned")).groupBy("series_id").agg(F.sum("checks").alias("aligned_checks")))
        if pairs is not None:
            tally.append(pairs.groupBy("series_id").agg(F.count(F.lit(1)).alias("compatible_pairs"), F.count_if("pruned").alias("pdub_prunes")))
            tally.append(found.groupBy("series_id").agg(F.count(F.lit(1)).alias("generated_patterns")))
        if not total:
            break
        if m >= min_len:
            offers, offered = [*offers, found.select(COLUMNS)], offered + total
            if offered > FEW:  # what can't be among the first any more isn't read again
                offers, offered = [stored(top().select(COLUMNS), "top")], 0
        if m == most:
            break
        with_theta = lambda x: x.withColumn("theta", F.lit(None).cast("double")) if not offers else x.join(X.theta(top(), topk), "series_id", "left")
        if not exact or pairs is None:
            found = with_theta(found)
        lost = F.lit(use_dub) & F.coalesce(B.below(B.dub(F.col("ub")), F.col("theta")), F.lit(False))
        marked, size = counted(found.withColumn("lost", lost), "marked", lost=F.count_if(lost))
        tally.append(marked.groupBy("series_id").agg(F.count_if("lost").alias("dub_prunes"), F.count_if(~F.col("lost")).alias("pair_attempts"), *([F.count_if(~F.col("lost")).alias("expanded_patterns")] if pairs is not None else [])))
        live, alive = marked.where("NOT lost"), total - size["lost"]
        if exact:  # theta of the whole level, which holds before the next
            live = with_theta(live.drop("theta"))
        pairs, most_pairs = _pairs(live), alive * (m + 1)
        if not use_pdub:
            pairs = pairs.withColumn("pruned", F.lit(False))
        if exact or most_pairs > FEW:
            pairs = stored(pairs, "pairs")
        parents = level.join(if_few(live.select("series_id", "ranks"), alive), ["series_id", "ranks"], "left_semi") if alive < total or exact else level
        met = J.aligned(parents)
        if use_pdub:
            met = met.join(if_few(pairs.where("pruned").select("series_id", "p", "q"), most_pairs), ["series_id", "p", "q"], "left_anti")
        level = J.fuse(met)
    last = top()
    if last is None:
        last = X.top_k(spark.createDataFrame([], "series_id string, n int, m int, ranks array<int>, n_occ long, support double"), topk)
    return Search(last.withColumn("pattern", R.compact(F.col("ranks"))), _tally(tally, spark))


def threshold_search(series: DataFrame, min_sup: float, max_len: int = 0, k: float | None = None, times: float = 1.0, nested: bool = False) -> Search:
    """Patterns with at least ``min_sup`` whose prefix and suffix were kept too, level by level, ranked.

    Support can grow from a pattern to its extension, so this is less than every pattern above the threshold.
    ``nested`` counts pair attempts as a search without an index would. Counters are made only when they are read.
    """
    most = (series.agg((F.max("pos") + 1).alias("n")).first().n or 0) if max_len <= 0 else max_len
    level, out, m, tally = X.seeds(series).where("ranks IS NOT NULL"), None, 2, []
    while True:
        level = stored(level, "level")
        kept, size = counted(X.pattern_supports(level, k, times).where(F.col("support") + B.EPS >= min_sup), "kept")
        out = kept if out is None else out.unionByName(kept)
        if m > 2:
            tally.append(kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("expanded_patterns")))
            tally.append(level.select("series_id", "ranks").distinct().groupBy("series_id").agg(F.count(F.lit(1)).alias("generated_patterns")))
        if m >= most or not size["rows"]:
            break
        parents = level.join(if_few(kept.select("series_id", "ranks"), size["rows"]), ["series_id", "ranks"], "left_semi")
        pairs = J.pair_counters(kept)
        tally.append(pairs.select("series_id", F.col("nested_attempts" if nested else "hash_attempts").alias("pair_attempts"), "compatible_pairs"))
        tally.append(J.aligned_checks(parents, J.pair_join(kept)).groupBy("series_id").agg(F.sum("checks").alias("aligned_checks")))
        level = J.fuse_join(parents)
        m += 1
    top = X.ranked(out.select(COLUMNS)).withColumn("pattern", R.compact(F.col("ranks")))
    return Search(top, _tally(tally, series.sparkSession))


def threshold(series: DataFrame, min_sup: float, max_len: int = 0, k: float | None = None, times: float = 1.0) -> DataFrame:
    """The answer of ``threshold_search``."""
    return threshold_search(series, min_sup, max_len, k, times).top


def threshold_complete(series: DataFrame, min_sup: float, max_len: int, k: float | None = None, times: float = 1.0) -> DataFrame:
    """All patterns with at least ``min_sup``, whatever their parts have."""
    found = X.pattern_supports(X.occurrences(series, 2, max_len), k, times)
    return X.ranked(found.where(F.col("support") + B.EPS >= min_sup)).withColumn("pattern", R.compact(F.col("ranks")))


MODES = {
    "bruteforce": {}, "hjtopk": {}, "tk": {"use_pdub": True, "use_dub": True}, "tk-naive": {"use_pdub": True, "use_dub": True},
    "tk-no-pdub": {"use_pdub": False, "use_dub": True}, "tk-no-dub": {"use_pdub": True, "use_dub": False}, "tk-no-bounds": {"use_pdub": False, "use_dub": False},
    "hj": {}, "baseline": {},
}
ALIASES = {"full": "tk", "dub-only": "tk-no-pdub", "pdub-only": "tk-no-dub", "no-bounds": "tk-no-bounds"}


def search(series: DataFrame, mode: str = "tk", topk: int = 10, min_sup: float = 1.5, min_len: int = 2, max_len: int = 0, k: float | None = None, times: float = 1.0) -> Search:
    """The ranked answer of a mode, by name, and the counters of the search that the mode stands for."""
    mode = ALIASES.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode in ("hj", "baseline"):
        return threshold_search(series, min_sup, max_len, k, times, nested=mode == "baseline")
    flags = MODES[mode] or {"use_pdub": False, "use_dub": False}
    return top_k_pruned(series, topk, min_len, max_len, k, times, exact=True, **flags)


def mine(series: DataFrame, mode: str = "tk", topk: int = 10, min_sup: float = 1.5, min_len: int = 2, max_len: int = 0, k: float | None = None) -> DataFrame:
    """The ranked answer of a mode, by name."""
    mode = ALIASES.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode in ("hj", "baseline"):
        return threshold(series, min_sup, max_len, k)
    if mode in ("bruteforce", "hjtopk"):
        return top_k_one_pass(series, topk, min_len, max_len, k)
    return top_k_pruned(series, topk, min_len, max_len, k, **MODES[mode]).top
