"""Shared pieces of the corpus operators: table reading, word rules, scratch tables, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from decimal import Decimal
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII blanks that part words: space and 0x09 to 0x0D. ``bytes.split()`` parts at exactly these.
BLANKS = " \t\n\x0b\f\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(F.split(body, WORD_BREAK))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query that first sends this package to the Python workers, once per session, wherever they start."""

    def run(spark: SparkSession, *args) -> DataFrame:
        context = spark.sparkContext
        if not getattr(context, "_rankweave_shipped", False):
            top = Path(__file__).resolve().parent.parent
            packed = Path(tempfile.mkdtemp(prefix="rankweave-")) / "rankweave.zip"
            with zipfile.ZipFile(packed, "w") as z:
                for f in sorted(top.rglob("*.py")):
                    z.write(f, f.relative_to(top.parent))
            context.addPyFile(str(packed))
            context._rankweave_shipped = True
        return query(spark, *args)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see; set once per session where the cluster names none."""
    jsc = spark.sparkContext._jsc.sc()
    at = spark.conf.get("spark.checkpoint.dir", None) or (jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rankweave-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rankweave-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast: some tens of MB.
FEW = 500_000


def if_few(stored_rows: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it has at most FEW rows, and joined by shuffles beyond."""
    return F.broadcast(stored_rows) if stored_rows.limit(FEW + 1).count() <= FEW else stored_rows


#: A key is hot with more rows than this, and more than 1 / SPREAD of all rows.
HOT, SPREAD = 10_000, 1000


def salted_join(many: DataFrame, few: DataFrame, on: list[str], weight: str, how: str = "inner", wide: bool = False) -> DataFrame:
    """``many`` joined with ``few``, a stored table, unique by ``on``, that tells in ``weight`` how many rows of ``many`` a row meets.

    The rows of hot keys are dealt over several tasks. There are less than SPREAD such keys, so they can be
    broadcast; the rows of ``few`` for them are repeated for each task, 2 * SPREAD in all at most. If ``few`` isn't
    ``wide`` and has at most FEW rows, it is broadcast whole. ``weight`` is dropped.
    """
    seen = few.agg(F.sum(weight).alias("total"), F.max(weight).alias("most"), F.count(F.lit(1)).alias("n")).first()
    if seen.n <= FEW and not wide:
        return many.join(F.broadcast(few.drop(weight)), on, how)
    share = max(HOT, -(-(seen.total or 0) // SPREAD))
    if (seen.most or 0) <= share:
        return many.join(few.drop(weight), on, how)
    few = few.withColumn("__salts", F.ceil(F.col(weight) / F.lit(share)).cast("int")).drop(weight)
    hot = few.where("__salts > 1").select(*on, "__salts")
    dealt = many.join(F.broadcast(hot), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return dealt.join(few, [*on, "__salt"], how).drop("__salt")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``, of any type with an order; component is the least node reachable.

    Alternating large-star and small-star rounds, each a shuffle on nodes with partial minima, until
    nothing changes. Every round is a table in the shared folder; no links come to the driver.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    old = mark(edges)
    while old[0]:
        # only links to greater nodes move, but a node's least neighbour may be less
        least = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("k"))
        least = stored(least.where("k > 0").select("a", F.least("a", "m").alias("m"), "k"), "least")
        large = salted_join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), least, ["a"], "k").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k")), "least")
        small = salted_join(large, least, ["a"], "k").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stored(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        new = mark(edges)
        if new == old:
            break
        old = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def wide_id(high: Column, low: Column) -> Column:
    """126 bits of two 64-bit hashes as one number, which hash aggregation can take the least of."""
    return (high.cast("decimal(38,0)") * F.lit(Decimal(1 << 62)).cast("decimal(19,0)") + F.shiftrightunsigned(low, 2)).cast("decimal(38,0)")


def _apart(now: DataFrame) -> DataFrame:
    """The rows of ``now(key, id, label, ...)`` under whose key there are two labels."""
    found = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("k")).where("low < high")
    return stored(salted_join(now, stored(found.select("key", "k"), "apart"), ["key"], "k", "left_semi"), "now")


def _bounded(now: DataFrame, book: DataFrame) -> DataFrame:
    """``now`` with the columns of ``book(id, size, most, own)``, without the rows for which the sizes under their key rule out every partner."""
    now = stored(now.join(book, "id"), "now")
    sizes = now.groupBy("key").agg(F.min("size").alias("smallest"), F.max("most").alias("largest"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return salted_join(now, stored(sizes, "sizes"), ["key"], "k").where("smallest <= most AND size <= largest").drop("smallest", "largest")


def _fitting(now: DataFrame) -> DataFrame:
    """All pairs (a, b) of ``now(key, id, label, size, most)`` that share a key, fit and are apart."""
    other = now.select("key", F.struct("id", "label", "size", "most").alias("other"))
    pairs = now.join(other, "key").where("id < other.id AND label <> other.label AND size <= other.most AND other.size <= most")
    return pairs.select(F.col("id").alias("a"), F.col("other.id").alias("b"))


def hub_links(
    keyed: DataFrame, similar: Callable[[DataFrame], DataFrame], linkable: Callable[[DataFrame], DataFrame], hub_rounds: int = 3, last: Callable[[DataFrame], DataFrame] = _fitting
) -> DataFrame:
    """(id, component) of every id that ``similar`` links with another that shares a key with it.

    ``keyed(key, id)``: candidates share a key; of keys with the same ids, told by their number and 128 bits, one
    is looked at. ``similar`` keeps the pairs (a, b) that are linked; few are an a. In each
    round, the members of a key that are not yet in one component are compared with one of them, the hub:
    first the one with most keys, then the one with the fewest features of its own, then any. After the first
    round, ``linkable`` gives for the ids(id) that are still apart from some of their candidates their size,
    the greatest size ``most`` that a partner can have, and the number of features ``own`` that no other of
    them has; ids for which a bound on these rules out any link may be left out. Partners fit if each one's
    size is within the other's bound. After ``hub_rounds`` rounds the pairs (a, b) that ``last`` makes of
    ``now(key, id, label, size, most, own)`` are compared: all that fit, or those of them that it can't rule
    out. A group that hubs join costs its size a round, not its square, so do the members that no size under
    their keys fits, and no link between components is lost.
    """
    spark = keyed.sparkSession
    prints = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"p{i}") for i in (0, 1)]
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), *prints).where("k > 1")
    several = several.groupBy("k", "p0", "p1").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("m")).select("key", "k", "m")
    keyed = stored(salted_join(keyed, stored(several, "several"), ["key"], "k"), "keys")
    now = keyed.join(keyed.groupBy("id").agg((-F.sum("m")).alias("own")), "id").drop("m").withColumn("label", F.col("id"))
    edges, tried, found = None, None, None
    for turn in range(hub_rounds + 1):
        if turn:
            now = _apart(now)
        if turn == 1:
            ids = stored(now.select("id").distinct(), "ids")
            now = _apart(_bounded(now.drop("own"), linkable(ids)))
        if now.isEmpty():
            break
        if turn < hub_rounds:
            fits = "size <= other.most AND other.size <= most" if turn else "true"
            order = F.struct(F.xxhash64("id", F.lit(turn)).alias("own") if turn > 1 else F.col("own"), "id", "label", *(["size", "most"] if turn else []))
            hubs = stored(now.groupBy("key").agg(F.min(order).alias("other"), F.count(F.lit(1)).alias("k")), "hubs")
            pairs = salted_join(now, hubs, ["key"], "k").where(f"label <> other.label AND {fits}")
            pairs = pairs.select(F.col("other.id").alias("a"), F.col("id").alias("b")).distinct()
        else:
            pairs = last(now).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        new = stored(similar(pairs), "similar")
        tried = pairs if tried is None else tried.unionByName(pairs)
        edges = new if edges is None else edges.unionByName(new)
        found = stored(components(edges), "components").toDF("id", "component")
        now = now.drop("label").join(found.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    return spark.createDataFrame([], keyed.select("id", F.col("id").alias("component")).schema) if found is None else found
