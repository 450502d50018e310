"""python -m rankweave --input FILE [--mode tk] [--topK 10] [--minSup 1.5] [--minLen 2] [--maxLen 0] [--forgetting 1/n]

With --run, measured runs instead: five, public, ablation or campaign of the series in --input (a file or a folder), or the
benchmark of a properties file; logs, canonical rows and the environment go to folders under --output.
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import windows as X
from .operators.scratch import stored
from .plans import mining, runners
from .sources import series, sinks, text_source


def _named(spark: SparkSession, path: str):
    """Series of a file or folder, named by their files."""
    return text_source.read_series(spark, path).withColumn("series_id", F.element_at(F.split("series_id", "/"), -1))


def run(spark: SparkSession, kind: str, path: str, output: str, warm: int, repeats: int) -> None:
    out = output.rstrip("/")
    if kind == "benchmark":
        b = runners.read_benchmark(path)
        top = Path(path).resolve().parent.parent
        values = reduce(lambda x, y: x.unionByName(y), (_named(spark, str(top / d)) for d in b.datasets))
        sinks.write_csv(runners.benchmark(values, b), f"{out}/benchmark")
        return
    values = stored(_named(spark, path), "input")
    modes = {"five": runners.FIVE, "public": runners.PUBLIC, "ablation": runners.ABLATION, "campaign": runners.FIVE}[kind]
    if kind == "ablation":
        sinks.write_tsv(runners.ablation(values), f"{out}/ablation_canonical")
    else:
        sinks.write_tsv(runners.canonical(values, modes), f"{out}/canonical")
    log = runners.campaign(values, warm=warm, repeats=repeats) if kind == "campaign" else runners.run_log(values, modes, (runners.CENTRAL._replace(phase="ablation" if kind == "ablation" else "public"),), warm, repeats)
    sinks.write_csv(log, f"{out}/runs")
    lines = runners.environment(spark, warmups=warm, repeats=repeats, modes=modes).splitlines()
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/environment")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rankweave")
    p.add_argument("--input", required=True)
    p.add_argument("--mode", default="tk", choices=[*mining.MODES, *mining.ALIASES])
    p.add_argument("--forgetting", type=float)
    p.add_argument("--topK", type=int, default=10)
    p.add_argument("--minSup", type=float, default=1.5)
    p.add_argument("--minLen", type=int, default=2)
    p.add_argument("--maxLen", type=int, default=0)
    p.add_argument("--run", choices=["five", "public", "ablation", "campaign", "benchmark"])
    p.add_argument("--output", default="results")
    p.add_argument("--warmups", type=int, default=5)
    p.add_argument("--repeats", type=int, default=10)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.run:
        run(spark, a.run, a.input, a.output, a.warmups, a.repeats)
        return 0
    values = stored(series.read_text(spark, a.input), "input")
    answer = stored(mining.mine(values, a.mode, a.topK, a.minSup, a.minLen, a.maxLen, a.forgetting), "answer")
    longest = answer.agg(F.max("m")).first()[0]
    if longest:
        ends = X.occurrences(values, 2, longest).join(answer.select("series_id", "ranks"), ["series_id", "ranks"], "left_semi")
        ends = ends.groupBy("series_id", "ranks").agg(F.array_sort(F.collect_list("pos")).alias("ends"))
        for row in sinks.result_lines(answer.join(ends, ["series_id", "ranks"])).orderBy("series_id", "rank").toLocalIterator():
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
