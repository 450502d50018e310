"""Joins of overlapping patterns and of their occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ranks as R
from .windows import CHUNK, dealt, many


def pair_join(patterns: DataFrame) -> DataFrame:
    """(series_id, p, q) for all patterns of one length where p without its first is q without its last."""
    p = patterns.select("series_id", F.col("ranks").alias("p"), R.suffix_key(F.col("ranks")).alias("key"))
    q = patterns.select("series_id", F.col("ranks").alias("q"), R.prefix_key(F.col("ranks")).alias("key"))
    return p.join(q, ["series_id", "key"]).drop("key")


def pair_counters(patterns: DataFrame) -> DataFrame:
    """Per series: frontier size, probes of the hash join, of the nested loop, and compatible pairs."""
    size = patterns.groupBy("series_id").agg(F.count(F.lit(1)).alias("hash_attempts")).withColumn("nested_attempts", F.col("hash_attempts") * F.col("hash_attempts"))
    pairs = pair_join(patterns).groupBy("series_id").agg(F.count(F.lit(1)).alias("compatible_pairs"))
    return size.join(pairs, "series_id", "left").na.fill(0, ["compatible_pairs"])


def aligned(occurred: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each occurrence with the one that ends a step before it: series_id, pos, n, m, p, q, first and last value of both together.

    ``occurred`` has the columns of ``windows.seeds``: every occurrence carries its first and last value, so one
    sorted pass over the occurrences finds neighbours by ``lag``, without a join on positions or with the series. An
    occurrence at the end of a chunk goes to the next one, too; one exchange, on series and chunk.
    """
    own, ahead = F.floor(F.col("pos") / chunk), F.floor((F.col("pos") + 1) / chunk)
    x = occurred.select("series_id", "pos", "n", "m", "ranks", "first", "last", F.explode(F.when(own == ahead, F.array(own)).otherwise(F.array(own, ahead))).alias("chunk"))
    x = dealt(x, many(occurred), "series_id", "chunk")
    before = F.lag(F.struct("pos", "ranks", "first")).over(W.Window.partitionBy("series_id", "chunk").orderBy("pos"))
    x = x.withColumn("before", before).where((F.col("before.pos") == F.col("pos") - 1) & (own == F.col("chunk")))
    return x.select("series_id", "pos", "n", "m", F.col("before.ranks").alias("p"), F.col("ranks").alias("q"), F.col("before.first").alias("first"), "last")


def fuse(met: DataFrame) -> DataFrame:
    """Occurrences one longer, with their first and last value, of aligned ones; those whose ends are equal go."""
    child = R.fused(F.col("p"), F.col("q"), F.col("first") < F.col("last"))
    return met.where("first <> last").select("series_id", "pos", "n", (F.col("m") + 1).alias("m"), child.alias("ranks"), "first", "last")


def with_ends(occurred: DataFrame, series: DataFrame) -> DataFrame:
    """Occurrences with their first and last value, looked up in their series."""
    last = series.select("series_id", "pos", F.col("value").alias("last"))
    first = series.select("series_id", F.col("pos").alias("from"), F.col("value").alias("first"))
    return occurred.join(last, ["series_id", "pos"]).withColumn("from", F.col("pos") - F.col("m") + 1).join(first, ["series_id", "from"]).drop("from")


def fuse_join(occurred: DataFrame, series: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Occurrences one longer: each with the one that ends a step later, if first and last value differ.

    ``series`` is needed only if the occurrences don't carry their first and last value; ``pairs(series_id, p, q)``, if
    given, are the only pairs fused.
    """
    met = aligned(occurred if "first" in occurred.columns else with_ends(occurred, series))
    return fuse(met if pairs is None else met.join(pairs.select("series_id", "p", "q"), ["series_id", "p", "q"], "left_semi"))


def aligned_checks(occurred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Steps of a merge of each pair's ends: of the union of p's ends plus one and q's ends, those up to the lesser maximum.

    Counts of p's, of q's and of common ends are added; a pattern's ends are read once for each of its pairs, at most
    one more than its length, and only partial counts are shuffled.
    """
    key = ["series_id", "p", "q"]
    most = occurred.groupBy("series_id", "ranks").agg(F.max("pos").alias("most"))
    tops = pairs.select(*key).join(most.select("series_id", F.col("ranks").alias("p"), (F.col("most") + 1).alias("x")), ["series_id", "p"]).join(most.select("series_id", F.col("ranks").alias("q"), F.col("most").alias("y")), ["series_id", "q"])
    tops = tops.select(*key, F.least("x", "y").alias("top"))
    count = lambda side, shift: occurred.select("series_id", F.col("ranks").alias(side), (F.col("pos") + shift).alias("v")).join(tops, ["series_id", side]).groupBy(*key).agg(F.count_if(F.col("v") <= F.col("top")).alias("k"))
    ends = occurred.select("series_id", "pos", "n", "m", "ranks", F.lit(0).alias("first"), F.lit(0).alias("last"))
    common = aligned(ends).join(pairs.select(*key), key, "left_semi").groupBy(*key).agg((-F.count(F.lit(1))).alias("k"))
    parts = count("p", 1).unionByName(count("q", 0)).unionByName(common)
    return parts.groupBy(*key).agg(F.sum("k").alias("checks"))


def answer_diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows of two ranked answers that differ: by rank, pattern, or support beyond the tolerance."""
    left = a.select("series_id", "rank", F.col("ranks").alias("ra"), F.col("support").alias("sa"))
    right = b.select("series_id", "rank", F.col("ranks").alias("rb"), F.col("support").alias("sb"))
    same = (F.col("ra") == F.col("rb")) & (F.abs(F.col("sa") - F.col("sb")) <= tolerance)
    return left.join(right, ["series_id", "rank"], "full").where(~F.coalesce(same, F.lit(False)))
