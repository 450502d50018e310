"""Mixing sources to target weights by blocks, drawn counts and index permutations.

Every source's documents, in a fixed order, are one stream of words, cut into blocks of ``BLOCK`` words
(the last may be shorter). A source's target becomes a number of slots. Output shards of ``SHARD`` slots
draw how many slots each source gets from a multinomial with the weights still open, so that the counts
add up to the plan. Slot j of a source takes block perm(j mod blocks) of its pass j div blocks, perm being
a keyed Feistel permutation of the block numbers; slots and blocks meet in a join on (source, block).
A pass takes each block once, so a document is taken at most as often as its source is passed over, and
the source's last slot is cut short so that its words come to the rounded target.

The plan holds one row per source and is made on the driver; ``MAX_SOURCES`` bounds it. Draws are made in
two levels, super-shards on the driver and shards in tasks, and slots only in tasks. A hot source's stream
is laid out by (source, hash bucket), and its blocks are dealt by (source, block).

Results of the corner cases: null and blank texts have size 0 and are taken 0 times; a null source is a
source of its own, last in order; a source without words has target 0; repeated rows are documents of
their own; an empty table gives an empty result; columns beyond doc_id, text and source are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import _common as C

#: Words in a block, slots in an output shard, shards in a super-shard, hash buckets of a source's stream.
BLOCK, SHARD, SUPER, BUCKETS = 128, 1024, 256, 4096
#: More sources than this are refused: the plan has a row for each, on the driver.
MAX_SOURCES = 100_000
SEED = 20_240_117


def cycle_weights(sources: list) -> list[float]:
    """3, 1, 2, repeating, by the sources' order."""
    return [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))]


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """``share`` times all sizes dealt by weight, none above ``most`` times its size; what is cut off is dealt again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weights[i] > most * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total if total else 0.0
            break
        for i in full:
            out[i] = most * sizes[i]
            open_.discard(i)
        left -= sum(out[i] for i in full)
    return out


class Permutation:
    """A keyed bijection of 0..n-1: a Feistel network of four rounds, walked until inside."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)) for i in range(4)]

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = x.astype(np.uint64)
        todo = np.arange(len(x))
        half = np.uint64(self.half)
        while len(todo):
            left, right = x[todo] >> half, x[todo] & self.mask
            for key in reversed(self.keys) if back else self.keys:
                if back:
                    left, right = right ^ self._f(left, key), left
                else:
                    left, right = right, left ^ self._f(right, key)
            x[todo] = (left << half) | right
            todo = todo[x[todo] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(x), False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(x), True)


def _key(seed: int, source: int, turn: int) -> int:
    return (seed * 1_000_003 + source) * 8_191 + turn


def slots_for(size: int, target: float, block: int, key: Callable[[int], int]) -> tuple[int, int]:
    """Number of slots of a source and the words its last slot takes, so that all come to the rounded target."""
    words, blocks = round(target), -(-size // block)
    if not size or not words:
        return 0, 0
    passes, rest = divmod(words, size)
    short = size - (blocks - 1) * block
    if not rest:
        last = int(Permutation(blocks, key(passes - 1))(np.array([blocks - 1]))[0])
        return passes * blocks, short if last == blocks - 1 else block
    at = int(Permutation(blocks, key(passes)).inverse(np.array([blocks - 1]))[0])
    more = -(-rest // block)
    if at < more:
        more = -(-(rest + block - short) // block)
    before = (more - 1) * block - (block - short if at < more - 1 else 0)
    return passes * blocks + more, rest - before


def draw(left: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k slots by source: multinomial by what is left of each source, over again for draws beyond it."""
    out = np.zeros_like(left)
    while k > 0:
        rest = left - out
        got = np.minimum(rng.multinomial(k, rest / rest.sum()), rest)
        out += got
        k -= int(got.sum())
    return out


def plan(sizes: DataFrame, weights: Callable[[list], list[float]], share: float, most: float, block: int, seed: int) -> pd.DataFrame:
    """One row per source: its number ``src`` in code point order, size, target, slots and last slot's words."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    rows = sorted(((r.source, int(r["size"])) for r in rows), key=lambda x: (x[0] is None, x[0] or ""))
    out = pd.DataFrame({"src": np.arange(len(rows)), "source": pd.Series([s for s, _ in rows], dtype=object), "source_size": np.array([n for _, n in rows], dtype="int64")})
    out["target"] = np.array(targets([n for _, n in rows], weights([s for s, _ in rows]), share, most), dtype="float64")
    both = [slots_for(n, t, block, lambda turn, s=s: _key(seed, s, turn)) for s, n, t in zip(out.src, out.source_size, out.target, strict=True)]
    return out.assign(slots=np.array([a for a, _ in both], dtype="int64"), last=np.array([b for _, b in both], dtype="int64"))


def slots(spark: SparkSession, book: pd.DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, src, turn, block, take) for every slot of the mixture."""
    schema = "shard long, slot int, src int, turn int, block long, take long"
    quota = book.slots.to_numpy("int64")
    total, big = int(quota.sum()), shard * SUPER
    if not total:
        return spark.createDataFrame([], schema)
    left, first, supers = quota.copy(), np.zeros_like(quota), []
    rng = np.random.default_rng([seed, 0])
    for i in range(-(-total // big)):
        got = draw(left, min(big, total - i * big), rng)
        supers.append((i, got.tolist(), first.tolist()))
        left, first = left - got, first + got
    sizes, last = book.source_size.to_numpy("int64"), book["last"].to_numpy("int64")

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, counts, firsts in zip(frame["super"], frame.counts, frame.firsts, strict=True):
                left, at = np.array(counts, dtype="int64"), np.array(firsts, dtype="int64")
                rng = np.random.default_rng([seed, 1, int(number)])
                for k in range(SUPER):
                    n = min(shard, int(left.sum()))
                    if not n:
                        break
                    got = draw(left, n, rng)
                    src = np.repeat(np.arange(len(got)), got)
                    j = at[src] + np.arange(n) - np.repeat(np.cumsum(got) - got, got)
                    blocks = -(-sizes[src] // block)
                    turn = j // np.maximum(blocks, 1)
                    index = np.empty(n, dtype="int64")
                    for s, t in {*zip(src.tolist(), turn.tolist(), strict=True)}:
                        own = (src == s) & (turn == t)
                        index[own] = Permutation(int(blocks[own][0]), _key(seed, s, t))(j[own] % blocks[own])
                    take = np.where(j == quota[src] - 1, last[src], np.minimum(block, sizes[src] - index * block))
                    place = rng.permutation(n)
                    yield pd.DataFrame({"shard": int(number) * SUPER + k, "slot": place.astype("int32"), "src": src.astype("int32"), "turn": turn.astype("int32"), "block": index, "take": take})
                    left, at = left - got, at + got

    rows = spark.createDataFrame(supers, "super long, counts array<long>, firsts array<long>")
    return rows.repartition(max(1, min(len(supers), 4096)), "super").mapInPandas(dealt, schema)


def streams(sizes: DataFrame, book: DataFrame) -> DataFrame:
    """Adds src, source_size, target and ``start``, the document's first word in its source's stream.

    Sums of hash buckets are small and give each bucket's start; only a bucket's rows are ordered together.
    """
    x = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")).join(F.broadcast(book), sizes.source.eqNullSafe(book.source)).select("doc_id", sizes.source, "size", "bucket", "src", "source_size", "target")
    sums = x.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    base = sums.withColumn("base", F.sum("n").over(W.Window.partitionBy("src").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1))).select("src", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    own = W.Window.partitionBy("src", "bucket").orderBy("doc_id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    return x.join(base, ["src", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(own), F.lit(0))).drop("bucket", "base")


def mixture(docs: DataFrame, weights: Callable[[list], list[float]] = cycle_weights, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as spans: doc_id, source, size, source_size, target, start, and for each slot that takes words of
    the document its shard, slot, turn, first word (from 0) and number of words. A document that no slot takes
    has one row with null slot and 0 words.
    """
    spark = docs.sparkSession
    sizes = C.stored(docs.select("doc_id", "source", C.n_words(F.col("text")).alias("size")), "sizes")
    book = plan(sizes, weights, share, most, block, seed)
    frame = spark.createDataFrame([tuple(x) for x in book[["src", "source", "source_size", "target"]].itertuples(index=False, name=None)], "src int, source string, source_size long, target double")
    placed = streams(sizes, frame)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    # both sides grow with the words, whatever size the optimiser assumes of the slots
    met = pieces.join(slots(spark, book, block, seed=seed).hint("merge"), ["src", "block"], "left")
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.coalesce("take", F.lit(0)))
    spans = met.withColumns({"first": lo - F.col("start"), "n": F.greatest(hi - lo, F.lit(0)).cast("long")})
    none = placed.where("size = 0").withColumns({"shard": F.lit(None).cast("long"), "slot": F.lit(None).cast("int"), "turn": F.lit(None).cast("int"), "first": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    columns = ["doc_id", "source", "size", "source_size", "target", "start", "shard", "slot", "turn", "first", "n"]
    return spans.select(columns).unionByName(none.select(columns))


def taken(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken, the words that the mix takes of it."""
    sums = mixture(docs, **how).groupBy("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("start")).alias("start")).agg(F.sum("n").alias("taken"), F.count(F.lit(1)).alias("rows"))
    copies = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("rows")).cast("int")  # rows without words have no place of their own
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy", "rows", "start")


def drawn(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """Rows of ``docs(doc_id, text, source, ...)`` as often as the mix takes their words, whole but for one a source.

    A row comes once for each time the mix takes it whole. The words taken beyond that make up whole rows too: a
    source's rows taken in part are put in order of a hash over their share (sequential Poisson sampling), and
    come until the source has as many words as the mix takes of it. The row at which that happens comes or goes
    if the source then is at most ``block`` words off, else its first words come.
    """
    key = ["doc_id", "source", "size"]
    like = lambda order: F.row_number().over(W.Window.partitionBy(*key).orderBy(order))
    mixed = taken(docs, block=block, **how).where("size > 0").withColumn("row", like(F.col("taken")))
    part = (F.pmod(F.xxhash64("doc_id", "source", "size", "row"), F.lit(1 << 40)) + 0.5) / (1 << 40)
    x = mixed.select(*key, "row", F.expr("taken div size").cast("int").alias("whole"), (F.col("taken") % F.col("size")).alias("rest"))
    x = C.stored(x.withColumn("q", F.when(F.col("rest") > 0, part * F.col("size") / F.col("rest"))).withColumn("bucket", F.floor(F.col("q") / (F.col("q") + 1) * BUCKETS).cast("int")), "taken")
    sums = x.where("rest > 0").groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.sum("rest").alias("rest"))
    before = W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("rest").over(W.Window.partitionBy("source")).alias("open"))
    own = W.Window.partitionBy("source", "bucket").orderBy("q", *key, "row").rowsBetween(W.Window.unboundedPreceding, -1)
    left = F.col("open") - F.col("base") - F.coalesce(F.sum("size").over(own), F.lit(0))
    last = F.when(F.least("left", F.col("size") - F.col("left")) > block, F.col("left")).when(F.col("left") * 2 >= F.col("size"), F.col("size")).otherwise(0)
    some = x.where("rest > 0").join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).withColumn("left", left)
    some = some.withColumn("words", F.when(F.col("left") <= 0, 0).when(F.col("left") >= F.col("size"), F.col("size")).otherwise(last).cast("long"))
    columns = [*key, "row", "whole", "words"]
    book = some.select(columns).unionByName(x.where("rest = 0").withColumn("words", F.lit(0).cast("long")).select(columns)).where("whole > 0 OR words > 0")
    rows = docs.withColumn("_size", C.n_words(F.col("text"))).withColumn("_row", F.row_number().over(W.Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))))
    book = book.toDF(*(f"_of_{c}" for c in columns))
    same = rows["doc_id"].eqNullSafe(book["_of_doc_id"]) & rows["source"].eqNullSafe(book["_of_source"]) & (F.col("_size") == F.col("_of_size")) & (F.col("_row") == F.col("_of_row"))
    times = F.concat(F.array_repeat(F.col("_size"), F.col("_of_whole")), F.when(F.col("_of_words") > 0, F.array("_of_words")).otherwise(F.array().cast("array<bigint>")))
    out = rows.join(book, same).withColumn("_words", F.explode(times))
    return out.withColumn("text", F.when(F.col("_words") < F.col("_size"), first_words(F.col("text"), F.col("_words"))).otherwise(F.col("text"))).select(docs.columns)


def first_words(text, n):
    """The text up to its n-th word, blanks between words as they are."""
    pieces = F.split(F.ltrim(text, F.lit(C.BLANKS)), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    return F.rtrim(F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), ""), F.lit(C.BLANKS))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
