"""A corpus pipeline: rules, line dedup, near-duplicate dedup, mixing and tokens, over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a frame that
``run`` writes as Parquet to the shared folder and reads again for the next. All but the last return the
columns of ``documents``; n_chars follows the text. Other columns are dropped.

Corner cases: a null text is an empty one, and the rules reject it, as they do any text of few words; a row
without a doc_id or with one that another row has passes through every stage as a row of its own; null sources
are one source; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import _common as C
from rankweave.llm import bpe, line_dedup, minhash, mixing, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand before, short ones if equal; one that loses all its words goes."""
    out = line_dedup.dedup(docs, exact_chars=1)
    return out.where((F.col("n_removed") == 0) | (F.length(F.btrim("text", F.lit(C.BLANKS))) > 0)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8.

    The one with the least doc_id stays; rows of one doc_id are told apart by their text, and of equal rows one
    stays. A row without a doc_id takes part under a hash of its text in its place. Texts without words have no
    group and stay, one for each doc_id.
    """
    own = docs.withColumn("__text_id", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.col("__text_id")))
    book = C.stored(minhash.near_duplicates(own.select(F.col("__id").alias("doc_id"), "text", "__text_id"), shingle=5, percent=80, keep=("__text_id",)), "book")
    stays = book.where("kept").groupBy("doc_id").agg(F.min("__text_id").alias("stays"))
    rows = book.groupBy("doc_id", "__text_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).join(stays, "doc_id", "left")
    rows = C.stored(rows.select(F.col("doc_id").alias("__id"), "__text_id", "n", (F.col("kept") & (F.col("__text_id") == F.col("stays"))).alias("kept")).where("NOT kept OR n > 1"), "rows")
    once = own.join(rows.select("__id", "__text_id"), ["__id", "__text_id"], "left_anti").select(COLUMNS)
    several = rows.where("kept").select("__id", "__text_id")
    if several.isEmpty():
        return once
    return once.unionByName(own.join(several, ["__id", "__text_id"], "left_semi").dropDuplicates(["__id", "__text_id"]).select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents 0 to 2 times, whole but for one a source, so that a source's words are those that the mix takes of it, to a block."""
    return mixing.drawn(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed as little-endian unsigned 32-bit integers, and their number."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cut_at_spaces=True)
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash", near_duplicates), ("mixing", mix), ("byte_bpe", tokens)]
STAGES = [(name, C.shipped(stage)) for name, stage in STAGES]

#: The draws of the mix and the merges of the encoding are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
