"""Canonical digests of ranked answers, and agreement of modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as X


def digests(ranked: DataFrame, places: int = 12) -> DataFrame:
    """(series_id, n, sha256): SHA-256 of the lines pattern, tab, support, newline, in rank order. Answers are top-k, so short."""
    line = F.concat("pattern", F.lit("\t"), F.format_string(f"%.{places}f", "support"), F.lit("\n"))
    lines = ranked.groupBy("series_id", "n").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    return lines.select("series_id", "n", F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), "").cast("binary"), 256).alias("sha256"))


def ordered_supports(ranked: DataFrame, series: DataFrame, times: float = 1.0) -> DataFrame:
    """A ranked answer with each support added in the order of its pattern's ends, as digests need it. Answers are short, so few ends are looked up."""
    longest = ranked.agg(F.max("m")).first()[0]
    if longest is None:
        return ranked
    own = X.occurrences(series, 2, longest).join(ranked.select("series_id", "ranks"), ["series_id", "ranks"], "left_semi")
    ends = X.pattern_ends(own, None, times).select("series_id", "ranks", "support")
    return ranked.drop("support").join(ends, ["series_id", "ranks"])


def agreement(rows: DataFrame) -> DataFrame:
    """Of (dataset, mode, sha256): the number of modes and of distinct digests, and whether they agree."""
    return rows.groupBy("dataset").agg(F.countDistinct("mode").alias("modes"), F.countDistinct("sha256").alias("digests")).withColumn("agree", F.col("digests") == 1)


def same_search(rows: DataFrame) -> DataFrame:
    """Of the ablation's rows: whether all modes of a dataset had equal counters."""
    return rows.groupBy("dataset").agg((F.countDistinct("aligned", "pdub_prunes", "dub_prunes", "npat") == 1).alias("same"))
