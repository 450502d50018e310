"""``spark.read.format("series")``: numbers of text files, read by ranges of bytes.

A file of any size is cut into ranges, each read by a task of its own. A number belongs to the range that it starts
in: a task passes over the rest of a number that began before its range, and reads on past its end until its last
number is whole. Blanks, commas and semicolons part numbers. Rows hold the file, the range and the place in
it, and the number as text; ``read_series`` makes series of them.

Files are opened in the tasks by Arrow's file systems, so they can be where these reach: local or shared folders,
HDFS, S3 and so on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.scratch import counted, if_few, stored

SCHEMA = "series_id string, part int, at int, token string"
#: Bytes of a range and of a read.
RANGE, READ = 64 << 20, 4 << 20
#: Small ranges grow, up to RANGE, until there are no more than about this many.
PARTS = 256
_SEPARATORS = bytes(x if x not in b",;\t\n\v\f\r" else 32 for x in range(256))


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, its prefix) of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[: len(path) - len(inner)]
    return fs.LocalFileSystem(), path, "file://"


@dataclass
class Range(InputPartition):
    path: str
    name: str
    part: int
    start: int
    end: int
    last: bool


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        system, inner, prefix = located(self.path)
        top = system.get_file_info(inner)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [top] if top.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and not any(p[:1] in "._" for p in f.path.removeprefix(inner).strip("/").split("/"))]
        size, out = max(self.range, min(RANGE, -(-sum(f.size for f in files) // PARTS))), []
        for f in sorted(files, key=lambda f: f.path):
            cuts = range(0, max(f.size, 1), size)
            out += [Range(f.path if prefix == "file://" else prefix + f.path, prefix + f.path, i, a, min(a + size, f.size), i == len(cuts) - 1) for i, a in enumerate(cuts)]
        return out

    def read(self, own: Range) -> Iterator[pa.RecordBatch]:
        system, inner, _ = located(own.path)
        at = 0
        for tokens in _tokens(system, inner, own):
            columns = [pa.array([own.name] * len(tokens)), pa.array([own.part] * len(tokens), pa.int32()), pa.array(range(at, at + len(tokens)), pa.int32()), pa.array(tokens, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["series_id", "part", "at", "token"])
            at += len(tokens)
        if not at and own.part == 0 and own.last:
            # a file without numbers is an error, as an empty text is
            yield pa.RecordBatch.from_arrays([pa.array([own.name]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([""])], ["series_id", "part", "at", "token"])


def _tokens(system: fs.FileSystem, path: str, own: Range) -> Iterator[list[str]]:
    """The numbers that start in a range, some at a time."""
    with system.open_input_file(path) as f:
        place = max(own.start - 1, 0)
        f.seek(place)
        skipping, leading, carry = own.start > 0, own.start == 0, b""
        while place < own.end:
            raw = f.read(min(READ, own.end - place))
            if not raw:
                break
            place += len(raw)
            if leading and (head := raw.lstrip()):
                leading = False
                if head[:1] in b",;":
                    yield [""]  # nothing before the first separator is no number
            block = raw.translate(_SEPARATORS)
            if skipping:  # what began before the range ends at the first separator
                cut = block.find(b" ")
                if cut < 0:
                    continue
                block, skipping = block[cut:], False
            block = carry + block
            cut = block.rfind(b" ") + 1
            carry = block[cut:]
            if words := block[:cut].split():
                yield [w.decode("utf-8", "replace") for w in words]
        while carry and (raw := f.read(256)):  # the last number goes on past the range
            block = raw.translate(_SEPARATORS)
            cut = block.find(b" ")
            carry += block if cut < 0 else block[:cut]
            if cut >= 0:
                break
        if carry:
            yield [carry.decode("utf-8", "replace")]


class SeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options)


def read_series(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Files, or all files in a folder, one series each, as ``read_text`` gives them, but read by ranges of bytes."""
    spark.dataSource.register(SeriesSource)
    read = spark.read.format("series").option("range", range_bytes).load(path)
    read = stored(read.select("series_id", "part", "at", (F.col("token").cast("double") + F.lit(0.0)).alias("value")), "tokens")
    before = W.Window.partitionBy("series_id").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = read.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("n"))
    starts, size = counted(sizes.select("series_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    return read.join(if_few(starts, size["rows"]), ["series_id", "part"]).select("series_id", (F.col("start") + F.col("at")).cast("int").alias("pos"), "value")
