"""Sources: every one gives series(series_id string, pos int from 0 and dense, value double).

A -0.0 becomes 0.0, so both are one value; NaN equals itself and is greatest; null values are dropped
before positions are given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.windows import SHARE, dealt, dense
from .text_source import located

#: Bytes of a file read at a time.
BLOCK = 8 << 20

MISSING = ("", ".", "ND", "NA", "NAN", "NULL")

#: The run log: one row per measured run.
RUN_LOG = (
    "phase string, dataset string, n int, mode string, k double, topk int, minlen int, maxlen int, rep int, runtime_ms double, patterns int, "
    "pair_attempts bigint, compatible_pairs bigint, pdub_prunes bigint, dub_prunes bigint, aligned_checks bigint, peak_heap_mb double"
)
CANONICAL = "dataset string, n int, mode string, k double, topk int, maxlen int, rank int, pattern string, support double, sha256 string"
ABLATION = "dataset string, mode string, sha256 string, npat bigint, aligned bigint, pdub_prunes bigint, dub_prunes bigint"


def _clean(value: Column) -> Column:
    return value.cast("double") + F.lit(0.0)


#: Rows of the longest series that are still sorted in one task each.
SHORT = 1 << 16
#: A series is large, beside a task's share, with over one part in so many of it.
LARGE = 16


def _read(df: DataFrame, series: Column, order: Sequence[str], value: Column) -> DataFrame:
    return df.select(series.cast("string").alias("series_id"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), _clean(value).alias("value")).where("value IS NOT NULL")


def from_table(df: DataFrame, series: Column, order: Sequence[str], value: Column, sizes: bool = False) -> DataFrame:
    """Series of a table's rows: ``order`` must be a total order inside a series. With ``sizes``, n is the series' length.

    The rows of each series are counted first. One shuffle, on the series, if all are short; ranges of rows if any is
    long, and pos then notes the number of all rows, by which later steps are dealt.
    """
    x = _read(df, series, order, value)
    rows, longest = x.groupBy("series_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    names = [f"o{i}" for i in range(len(order))]
    if longest > SHORT:
        x = dense(x, ["series_id"], names, -(-rows // SHARE) * 2, ["value"])
        x = x.select("series_id", F.col("pos").cast("int").alias("pos", metadata={"rows": rows}), "value", "n")
    else:
        whole = W.Window.partitionBy("series_id")
        # windows of several lengths stay in the same tasks; hashes would put several large series into one
        x = dealt(x, rows * 8, "series_id", ranges=longest * 8 * LARGE > SHARE)
        x = x.select("series_id", (F.row_number().over(whole.orderBy(*names)) - 1).alias("pos"), "value", F.count(F.lit(1)).over(whole).cast("int").alias("n"))
    return x if sizes else x.drop("n")


def from_large_table(df: DataFrame, series: Column, order: Sequence[str], value: Column, partitions: int | None = None) -> DataFrame:
    """As from_table, by ranges of rows however short the series are."""
    placed = dense(_read(df, series, order, value), ["series_id"], [f"o{i}" for i in range(len(order))], partitions, ["value"])
    return placed.select("series_id", F.col("pos").cast("int").alias("pos"), "value")


def from_arrays(df: DataFrame, series: Column, values: Column) -> DataFrame:
    """One series per row, from an array column."""
    x = df.select(series.cast("string").alias("series_id"), F.posexplode(F.filter(values.cast("array<double>"), lambda v: v.isNotNull())).alias("pos", "value"))
    return x.select("series_id", "pos", _clean(F.col("value")).alias("value"))


def from_text(df: DataFrame, series: Column, text: Column) -> DataFrame:
    """One series per text of numbers parted by blanks, commas and semicolons. A token that is no number is an error."""
    body = F.regexp_replace(F.btrim(text, F.lit(" \t\n\r\x0b\f")), r"[\s,;]+\z", "")
    return from_arrays(df, series, F.split(body, r"[\s,;]+"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one series each, named by the path."""
    return from_text(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()), F.col("path"), F.col("value"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "t"))


def from_dated_lines(lines: DataFrame, value_col: int = 1) -> DataFrame:
    """Of (path, line, t): comma-separated rows; a first line that starts with no digit is a header, short rows and missing values go."""
    cells = lines.where(F.trim("t") != "").where(~((F.col("line") == 0) & ~F.col("t").rlike(r"^\s*\d"))).withColumn("c", F.split("t", ","))
    raw = F.trim(F.get("c", F.lit(value_col)))
    kept = cells.where(F.size("c") > value_col).where(~F.upper(raw).isin(*MISSING))
    return from_table(kept, F.col("path"), ["line"], raw)


def read_dated_csv(spark: SparkSession, path: str, value_col: int = 1) -> DataFrame:
    return from_dated_lines(_lines(spark, path), value_col)


def from_sunspot_lines(lines: DataFrame) -> DataFrame:
    """Of (path, line, t): rows of at least five fields parted by semicolons or commas; the fifth counts, if not negative."""
    kept = lines.where((F.trim("t") != "") & ~F.trim("t").startswith("#")).withColumn("c", F.split(F.regexp_replace("t", ",", ";"), ";")).where(F.size("c") >= 5)
    value = F.trim(F.get("c", F.lit(4))).cast("double")
    return from_table(kept.where(value >= 0), F.col("path"), ["line"], value)


def read_sunspots(spark: SparkSession, path: str) -> DataFrame:
    return from_sunspot_lines(_lines(spark, path))


def read_run_log(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    df = spark.read.schema(RUN_LOG).option("header", True).csv(path)
    return df if phase is None else df.where(F.col("phase") == phase)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANONICAL).option("header", True).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)


def read_ablation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ABLATION).option("header", True).option("sep", "\t").csv(path)


def last_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def file_digests(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """name, sha256 and, against ``expected(name, want)``, status: ok, changed, missing or unknown.

    The driver lists a path, a folder or a pattern of paths; each file is read and hashed a block at a time in a task,
    so it can have any size.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for top in system.globStatus(at) or () for f in (system.listStatus(top.getPath()) if top.isDirectory() else [top]) if f.isFile() and f.getPath().getName()[:1] not in "._"]
    listed = spark.createDataFrame([(f.getPath().toString(), f.getPath().getName()) for f in found], "path string, name string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for uri in batch.column("path").to_pylist():
                system, inner, _ = located(uri)
                total = hashlib.sha256()
                with system.open_input_stream(inner) as f:
                    while block := f.read(BLOCK):
                        total.update(block)
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sums, pa.string())], ["name", "sha256"])

    files = listed.repartition("path").mapInArrow(hashed, "name string, sha256 string")
    if expected is None:
        return files
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("sha256") == F.col("want"), "ok").otherwise("changed")
    return files.join(expected, "name", "full").withColumn("status", status)


def verified(digests: DataFrame) -> DataFrame:
    """``digests`` against expected ones, with an error, when they are read, for a file that changed or is missing."""
    wrong = F.raise_error(F.concat(F.lit("file "), "name", F.lit(" is "), "status")).cast("string")
    return digests.withColumn("status", F.when(F.col("status").isin("changed", "missing"), wrong).otherwise(F.col("status")))
