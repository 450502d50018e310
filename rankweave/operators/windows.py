"""Windows of series, their patterns, and aggregates of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ranks as R
from .scratch import counted, if_few, stored

#: Positions of a series in one piece of work; chunks overlap by the window length less one.
CHUNK = 1 << 14
#: Rows or windows dealt to a task, where their number is known.
SHARE = 1 << 19


def dealt(x: DataFrame, rows: int, *keys: str, ranges: bool = False) -> DataFrame:
    """By keys, hashed or in ``ranges`` of about equally many rows, to as many tasks as ``rows`` need, which their bytes wouldn't tell; few rows as the session deals them."""
    tasks = -(-rows // SHARE)
    if tasks <= 1:
        return x
    return (x.repartitionByRange if ranges else x.repartition)(max(tasks, x.sparkSession.sparkContext.defaultParallelism), *keys)


def many(series: DataFrame) -> int:
    """Rows of series too long for one task each, as their source noted; 0 where it noted none."""
    return series.schema["pos"].metadata.get("rows", 0)


def sized(series: DataFrame) -> DataFrame:
    """Adds n, the length of the series, where its source has not: a small aggregate joined back, since a window would hold a series in one task."""
    return series if "n" in series.columns else series.join(series.groupBy("series_id").agg((F.max("pos") + 1).alias("n")), "series_id")


def decay(k: float | None, times: float = 1.0) -> Column:
    """The forgetting factor: given, or ``times`` / n of the series."""
    if k is not None and not k > 0:
        raise ValueError("the forgetting factor must be above 0")
    return F.lit(k) if k is not None else F.lit(times) / F.col("n")


def windows(series: DataFrame, min_len: int, max_len: int, chunk: int = CHUNK) -> DataFrame:
    """series_id, pos (of the last value), n, m and win, for every contiguous window of min_len to max_len values.

    A series is cut into chunks, each with the max_len - 1 values before it, so a long one takes many tasks.
    """
    return _cut(series, min_len, max_len, chunk).drop("chunk")


def _cut(series: DataFrame, min_len: int, max_len: int, chunk: int = CHUNK) -> DataFrame:
    """``windows`` with their chunk, by which they are dealt."""
    if min_len < 1 or max_len < min_len:
        raise ValueError("window lengths must be from 1 up, the least first")
    x = sized(series)
    own = F.floor(F.col("pos") / chunk).cast("int")
    ahead = F.floor((F.col("pos") + (max_len - 1)) / chunk).cast("int")  # the chunks that look back to here
    x = x.select("series_id", "pos", "n", "value", F.explode(F.sequence(own, ahead)).alias("chunk"))
    x = dealt(x, many(series) * (max_len - min_len + 1), "series_id", "chunk")
    before = W.Window.partitionBy("series_id", "chunk").orderBy("pos").rowsBetween(1 - max_len, 0)
    x = x.withColumn("buf", F.collect_list("value").over(before)).where(own == F.col("chunk"))
    lengths = F.sequence(F.lit(min_len), F.least(F.lit(max_len), F.size("buf")))
    x = x.where(F.size("buf") >= min_len).select("series_id", "chunk", "pos", "n", "buf", F.explode(lengths).alias("m"))
    return x.select("series_id", "chunk", "pos", "n", "m", F.slice("buf", -F.col("m"), F.col("m")).alias("win"))


def occurrences(series: DataFrame, min_len: int, max_len: int, chunk: int = CHUNK, ends: bool = False) -> DataFrame:
    """series_id, pos, n, m and ranks for every window without ties; with ``ends``, its first and last value, too."""
    own = [F.get("win", F.lit(0)).alias("first"), F.element_at("win", -1).alias("last")] if ends else []
    return windows(series, min_len, max_len, chunk).select("series_id", "pos", "n", "m", R.rank_encode(F.col("win")).alias("ranks"), *own).where("ranks IS NOT NULL")


def pattern_counts(occurred: DataFrame) -> DataFrame:
    return occurred.groupBy("series_id", "n", "m", "ranks").agg(F.count(F.lit(1)).alias("n_occ"))


def pattern_supports(occurred: DataFrame, k: float | None = None, times: float = 1.0) -> DataFrame:
    """n_occ and support of every pattern, by partial sums; no list of positions is gathered."""
    w = R.weight(F.col("pos"), F.col("n"), decay(k, times))
    return occurred.withColumn("w", w).groupBy("series_id", "n", "m", "ranks").agg(F.count(F.lit(1)).alias("n_occ"), R.exact_sum(F.col("w")).alias("support"))


def pattern_ends(occurred: DataFrame, k: float | None = None, times: float = 1.0) -> DataFrame:
    """As pattern_supports, with the sorted ends, and the support added in their order."""
    listed = occurred.groupBy("series_id", "n", "m", "ranks").agg(F.array_sort(F.collect_list("pos")).alias("ends"))
    return listed.withColumns({"n_occ": F.size("ends").cast("long"), "support": R.folded_sum(F.col("ends"), F.col("n"), decay(k, times))})


def weight_prefixes(occurred: DataFrame, k: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """Adds the running sum of weights of a pattern's occurrences.

    Two levels: running sums inside chunks of positions, and the sums of the chunks before, so a pattern with any
    number of occurrences takes many tasks, and only its chunks' sums meet in one.
    """
    key = ["series_id", "m", "ranks"]
    x = occurred.withColumns({"__w": R.weight(F.col("pos"), F.col("n"), decay(k)), "__c": F.floor(F.col("pos") / chunk)})
    earlier = W.Window.partitionBy(*key).orderBy("__c").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = x.groupBy(*key, "__c").agg(F.sum("__w").alias("__s"))
    sums = sums.select(*key, "__c", F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)).alias("__before"))
    inside = W.Window.partitionBy(*key, "__c").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    return x.join(sums, [*key, "__c"]).withColumn("prefix", F.col("__before") + F.sum("__w").over(inside)).drop("__w", "__c", "__before")


def dense(rows: DataFrame, keys: list[str], order: list[str], partitions: int | None = None, kept: list[str] | None = None) -> DataFrame:
    """Adds pos, each row's place from 0 under its keys; ``order`` is total there. With ``kept``, the result has only the keys, these columns, pos and n, the number of the key's rows.

    Rows are sorted by ranges and counted a range at a time, so no key's rows meet in one task.
    """
    sort = [*keys, *order]
    ranged = (rows.repartitionByRange(partitions, *sort) if partitions else rows.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    own = rows.columns if kept is None else [*keys, *kept]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int")  # in the range
    ranged = stored(ranged.select(*own, F.spark_partition_id().alias("__part"), place.alias("__row")), "ranged")
    sizes = ranged.groupBy(*keys, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = W.Window.partitionBy(*keys)
    before = whole.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).cast("int").alias("n"))
    starts, size = counted(starts if kept is not None else starts.drop("n"), "starts")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]
    placed = ranged.alias("r").join(if_few(starts, size["rows"]).alias("s"), [F.col("r.__part") == F.col("s.__part"), *same])
    return placed.select(*(F.col(f"r.{c}") for c in own), (F.col("__row") + F.col("__shift")).alias("pos"), *(["n"] if kept is not None else []))


def seeds(series: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The length-2 occurrences with their first and last value, by comparison of neighbours, chunk by chunk; a tie gives null ranks."""
    first, last = F.get("win", F.lit(0)), F.get("win", F.lit(1))
    shape = F.when(first < last, F.array(F.lit(1), F.lit(2))).when(first > last, F.array(F.lit(2), F.lit(1)))
    return windows(series, 2, 2, chunk).select("series_id", "pos", "n", F.lit(2).alias("m"), shape.alias("ranks"), first.alias("first"), last.alias("last"))


def ranked(patterns: DataFrame) -> DataFrame:
    """Adds rank in the total order: support down, length up, pattern up."""
    by = W.Window.partitionBy("series_id").orderBy(F.desc("support"), "m", "ranks")
    return patterns.withColumn("rank", F.row_number().over(by))


def top_k(patterns: DataFrame, k: int) -> DataFrame:
    """The k first of each series; the optimiser keeps k per task before the shuffle."""
    return ranked(patterns).where(F.col("rank") <= k)


def theta(top: DataFrame, k: int) -> DataFrame:
    """(series_id, theta): the k-th support, where there are k."""
    return top.groupBy("series_id").agg(F.count(F.lit(1)).alias("c"), F.min("support").alias("theta")).where(F.col("c") >= k).select("series_id", "theta")
