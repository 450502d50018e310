"""Quality rules as a bitmask ledger, in DataFrame functions alone.

``ledger`` evaluates every rule once per document and stores the measurements and one long whose bit i
is set if rule i fails, as a table in the shared folder: a filter on it reads that table, and can't be pushed
below the measurements, where each use of one would measure the text anew. A policy is a version with a mask
of the rules it enforces; ``apply_policy`` and ``ablations`` work on the ledger by bitwise operations, so a
changed policy never measures a text again.

Results of the corner cases: a null text is an empty one; an empty text has all counts 0 and fails
``few_words``; repeated rows each get their row; columns beyond text pass through, and those with the name of an output are replaced.
Each document is measured inside its own row, so no key can gather rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")

#: Rule i is bit i; each is true for a document that fails it. Later versions may only append.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("shouting", "100 * n_upper > 50 * n_letters AND n_upper > 0"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    ("few_letters", "100 * n_letters < 60 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policies by version: the mask of the rules enforced.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["shouting"] | BIT["repeated_lines"], 3: (1 << len(RULES)) - 1}
CURRENT = 3


def _repeat_words(words: Column) -> Column:
    """Positions covered by 3-word windows that stand twice or more in the array."""
    n = F.size(words)
    at = lambda i: F.get(words, i)
    windows = F.when(n >= 4, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3), lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("w"), i.alias("i"))))
    return F.sort_array(windows)


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements of ``text``, which they follow; names of MEASURES in the input are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.drop(*MEASURES, "fail_bits").withColumn("__text", text).withColumn("__words", C.words(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(C.BLANKS))) > 0)
    df = df.withColumns({"__sorted": _repeat_words(F.col("__words")), "__lines": lines})
    w = lambda k: F.get(F.col("__sorted"), k)["w"]
    again = F.transform(F.filter("__sorted", lambda s, k: (w(k + 1) == s["w"]).eqNullSafe(True) | (w(k - 1) == s["w"]).eqNullSafe(True)), lambda s: s["i"])
    df = df.withColumn("__again", again)
    covered = F.size(F.array_distinct(F.flatten(F.transform("__again", lambda p: F.array(p, p + 1, p + 2)))))
    count = lambda kept: F.length(F.regexp_replace("__text", kept, "")).cast("long")
    measures = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": count(C.WORD_BREAK),
        "n_symbols": count("[^#*$%&|<>]+"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("__again").isNull(), F.lit(0)).otherwise(covered).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_letters": count("\\P{L}+"),
        "n_upper": count("\\P{Lu}+"),
    }
    return df.withColumns(measures).drop("__text", "__words", "__sorted", "__lines", "__again")


def evaluated(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the measurements of its ``text`` and ``fail_bits`` for every row, not stored."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return _measured(docs).withColumn("fail_bits", total.cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """The rows of ``evaluated``, stored."""
    return C.stored(evaluated(docs), "ledger")


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``kept`` and ``reasons``, the names of the enforced rules that fail."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]))
    names = F.array_compact(F.array(*(F.when(hit.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in BIT.items())))
    return book.withColumns({"kept": hit == 0, "reasons": names})


def ablations(book: DataFrame) -> DataFrame:
    """For each policy and rule in it: documents that fail the rule, that it alone rejects, and kept with and without it.

    The ledger shrinks to one row per distinct mask (at most 2 to the number of rules) before policies meet it.
    """
    cases = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    grid = [F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(mask).cast("long").alias("mask"), F.lit(bit).cast("long").alias("bit")) for v, mask in POLICIES.items() for name, bit in BIT.items() if mask & bit]
    x = cases.select("*", F.explode(F.array(*grid)).alias("p")).select("fail_bits", "n", "p.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    rest = hit.bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return x.groupBy("version", "rule").agg(
        total(hit.bitwiseAND(F.col("bit")) != 0).alias("fails"), total(hit == F.col("bit")).alias("only_this"), total(hit == 0).alias("kept"), total(rest == 0).alias("kept_without")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    book = apply_policy(C.stored(evaluated(docs).drop("text"), "ledger"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "fail_bits")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
t AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS p FROM a),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM t),
c AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM (SELECT doc_id, p, unnest([0, 1, 2]) AS o FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             length(regexp_replace(text, '\\P{L}+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '\\P{Lu}+', '', 'g'))::BIGINT AS n_upper
      FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
f AS (SELECT *, (%s)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & %d) <> 0 AS base_failed, (fail_bits & %d) = 0 AS kept, fail_bits FROM f
""" % (" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES)), BASE, POLICIES[CURRENT])
