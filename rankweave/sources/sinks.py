"""Sinks: tab- and comma-separated results, run logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_lines(ranked: DataFrame) -> DataFrame:
    """Of a ranked answer with ends: rank, pattern, support to 12 places and one-based ends, one text a row."""
    ends = F.concat(F.lit("["), F.array_join(F.transform("ends", lambda e: (e + 1).cast("string")), ", "), F.lit("]"))
    return ranked.select("series_id", "rank", F.concat_ws("\t", F.col("rank").cast("string"), "pattern", F.format_string("%.12f", "support"), ends).alias("line"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where a field holds a comma, as patterns do."""
    df.write.mode("overwrite").option("header", True).csv(path)


def canonical(ranked: DataFrame, digests: DataFrame, mode: str, k: float, topk: int, maxlen: int) -> DataFrame:
    """Ranked answers as canonical rows, with their series' digest."""
    sized = ranked.join(digests, "series_id")
    return sized.select(F.col("series_id").alias("dataset"), F.col("n").cast("int").alias("n"), F.lit(mode).alias("mode"), F.lit(k).alias("k"), F.lit(topk).alias("topk"), F.lit(maxlen).alias("maxlen"), "rank", "pattern", F.format_string("%.12f", "support").alias("support"), "sha256")


def markdown(df: DataFrame) -> str:
    """A small aggregate as a Markdown table, all rows of it, read a partition at a time."""
    rows = df.toLocalIterator()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def latex(df: DataFrame) -> str:
    rows = df.toLocalIterator()
    return "\n".join([" & ".join(df.columns) + r" \\ \hline", *(" & ".join("" if v is None else str(v) for v in r) + r" \\" for r in rows)])


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
