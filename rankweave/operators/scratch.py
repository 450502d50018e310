"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the driver and every executor see."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or (context._jsc.sc().getCheckpointDir().get() if context._jsc.sc().getCheckpointDir().isDefined() else None)
    if at is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rankweave-")
        context.setCheckpointDir(at)
    return f"{at.rstrip('/')}/rankweave-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again, which ends its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """``stored``, with the number of rows and other aggregates observed while it is written: no job of their own."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in sums.items())), what)
    return out, {n: v or 0 for n, v in seen.get.items()}


#: Rows of patterns, some hundred bytes each at most, that may be broadcast.
FEW = 100_000


def if_few(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast, if its counted rows are few."""
    return F.broadcast(df) if rows <= FEW else df
