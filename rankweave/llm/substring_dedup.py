"""Substring deduplication: words covered by a window of ``WINDOW`` words that starts anywhere else go.

Two operators:

``match_reference`` works on a bounded set of reference passages, such as benchmark items. Each shard of
passages becomes a suffix automaton, the shards are broadcast, and documents stream through them for their
matching statistics: the longest reference substring that ends at each word. Maximal spans of at least the
threshold are marked.

``self_dedup`` finds what repeats inside the corpus itself. There the reference is the corpus: automata of
all its shards, sent to all documents, cost shards times words and can't be broadcast within a bound, so
this operator works by fingerprints instead (the README has the figures):

1. Of every 24 successive 12-word grams the one of least hash is an anchor, so that equal windows have the
   same anchor at the same place. Texts that occur more than once go on as one. Only anchors that occur
   twice or more can lie in repeated windows.
2. The windows around such an anchor are a region. Regions alike in anchor and words that occur twice are
   repeated as a whole; of the others single windows are compared, keyed by anchor and window hash, with each
   other and with those of the repeated regions.
3. Windows found mark their words, which go from the text.

Both the counts and the marks are grouped by hash with partial sums; no group of occurrences meets in one
task. Windows are judged on the input. Results of the corner cases: a null text has no words; texts of
fewer words than a window lose none; repeated rows are documents of their own, so each is elsewhere for the
other; columns beyond doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Words in a window and in an anchor's gram.
WINDOW, GRAM = 35, 12
#: Candidate texts' ids that may be broadcast (8 bytes each).
FEW_IDS = 1_000_000
#: Words of reference passages in one automaton, and in all.
SHARD_WORDS, REFERENCE_WORDS = 100_000, 2_000_000
CACHE_WORDS = 300_000

_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)


class SuffixAutomaton:
    """All substrings of some sequences; ``matches`` gives matching statistics."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _new(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last: int, c) -> int:
        if (q := self.next[last].get(c)) is not None and self.length[q] == self.length[last] + 1:
            return q
        if q is not None:
            return self._clone(last, q, c)
        cur = self._new({}, 0, self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c) -> int:
        new = self._new(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def matches(self, sequence: list) -> list[int]:
        """Length of the longest substring that ends at each item."""
        out, state, n = [], 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
            out.append(n)
        return out


def spans(lengths: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal [first, end) word ranges that matches of at least ``least`` words cover, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        if n >= least:
            first = i + 1 - n
            while out and out[-1][1] >= first:
                first = min(first, out.pop()[0])
            out.append((first, i + 1))
    return out


def match_reference(docs: DataFrame, reference: DataFrame, least: int = WINDOW) -> DataFrame:
    """``docs`` with ``spans``: array of [first, end) word ranges of ``text`` that are substrings of a reference text."""
    found = reference.select("text").where("text IS NOT NULL").agg(F.sum(C.n_words(F.col("text"))).alias("n")).first().n or 0
    if found > REFERENCE_WORDS:
        raise ValueError(f"over {REFERENCE_WORDS} words of reference passages")
    shards, size = [SuffixAutomaton()], 0
    for row in reference.select("text").where("text IS NOT NULL").collect():
        words = row.text.encode().split()
        if size + len(words) > SHARD_WORDS and size:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(words)
        size += len(words)
    sent = [docs.sparkSession.sparkContext.broadcast(s) for s in shards]

    def matched(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = (text or "").encode().split()
            best = [max(x) for x in zip(*(s.value.matches(words) for s in sent), strict=True)]
            out.append([list(x) for x in spans(best, least)])
        return pd.Series(out)

    matched.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.withColumn("spans", F.pandas_udf(matched, "array<array<int>>")(F.col("text").cast("string")))


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """Hashes of a text's word ranges, and its anchors."""

    def __init__(self, hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.n, self.window, self.gram = len(hashes), window, gram
        self.inverse = np.concatenate([np.ones(1, "uint64"), np.multiply.accumulate(np.full(max(self.n, 1), _B_INVERSE, "uint64"))])
        powers = np.concatenate([np.ones(1, "uint64"), np.multiply.accumulate(np.full(max(self.n, 1), _B, "uint64"))])[: self.n]
        self.sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(hashes * powers, dtype="uint64")])

    def ranges(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words of each range [first, end)."""
        return _mix((self.sums[end] - self.sums[first]) * self.inverse[first] + (end - first).astype("uint64"))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each gram, and for each window the place of its anchor."""
        if self.n < self.window:
            return np.zeros(0, "uint64"), np.zeros(0, "int64")
        at = np.arange(self.n - self.gram + 1)
        grams = self.ranges(at, at + self.gram)
        wide, count = self.window - self.gram + 1, self.n - self.window + 1
        place = np.empty(count, dtype="int64")
        for i in range(0, count, 50_000):
            part = np.lib.stride_tricks.sliding_window_view(grams[i : min(i + 50_000, count) + wide - 1], wide)
            place[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
        return grams, place


def _prints(text: str | None, known: _Words, window: int) -> tuple[int, Fingerprints, list[bytes]]:
    words = (text or "").encode().split()
    return len(words), Fingerprints(np.fromiter(map(known.__getitem__, words), "uint64", len(words)), window), words


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scanned(docs: DataFrame, window: int) -> DataFrame:
    """Adds n_words, sha (of all words), and the anchors: their hashes ``h`` and places ``p``."""

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            rows = []
            for text in batch:
                n, prints, words = _prints(text, known, window)
                grams, place = prints.anchors()
                at = np.unique(place)
                rows.append((n, _sha(words), grams[at].view("int64"), at))
            yield pd.DataFrame(rows, columns=["n_words", "sha", "h", "p"])

    found.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn("s", F.pandas_udf(found, "n_words long, sha string, h array<long>, p array<int>")("text"))


def _regions(texts: DataFrame, window: int) -> DataFrame:
    """Of texts(c, m, text, ps): (c, m, anchor, region, s, n, w) for each anchor at the places ``ps``.

    s and n: the first window around the anchor and their number; w: the windows' hashes.
    """

    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = _Words()
        for texts, places in batches:
            out = []
            for text, ps in zip(texts, places, strict=True):
                _, prints, _ = _prints(text, known, window)
                grams, place = prints.anchors()
                cuts = np.flatnonzero(np.diff(place)) + 1
                first = np.concatenate([[0], cuts])
                end = np.concatenate([cuts, [len(place)]])
                own = np.isin(place[first], np.asarray(ps))
                first, end = first[own], end[own]
                at = np.arange(len(place))
                w = prints.ranges(at, at + window).view("int64")
                region = prints.ranges(first, end + window - 1).view("int64")
                anchor = grams[place[first]].view("int64")
                out.append([{"anchor": a, "region": r, "s": s, "n": e - s, "w": w[s:e].tolist()} for a, r, s, e in zip(anchor.tolist(), region.tolist(), first.tolist(), end.tolist(), strict=True)])
            yield pd.Series(out)

    found.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    kind = "array<struct<anchor:long,region:long,s:int,n:int,w:array<long>>>"
    return texts.withColumn("r", F.explode(F.pandas_udf(found, kind)("text", "ps"))).select("c", "m", "r.*")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """Of texts(c, text, marks): (c, kept, n_removed, sha): what is left when the marked windows' words go."""

    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, marks in batches:
            kept, gone, shas = [], [], []
            for text, own in zip(texts, marks, strict=True):
                words = (text or "").encode().split()
                step = np.zeros(len(words) + 1, dtype="int64")
                for first, n in ((x["s"], x["n"]) for x in own):
                    step[first] += 1
                    step[first + n + window - 1] -= 1
                left = [x for x, covered in zip(words, np.cumsum(step[:-1]) > 0, strict=True) if not covered]
                kept.append(b" ".join(left).decode())
                gone.append(len(words) - len(left))
                shas.append(_sha(left))
            yield pd.DataFrame({"kept": kept, "n_removed": gone, "sha": shas})

    found.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return texts.withColumn("k", F.pandas_udf(found, "kept string, n_removed long, sha string")("text", "marks")).select("c", "k.*")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(c, text) of the texts with an id in ``ids(c)``, once each."""
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return docs.select("c", "text").join(F.broadcast(ids) if few else ids, "c", "left_semi").dropDuplicates(["c"])


def self_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept: the words left of a text that lost some
    (null: none lost), for every row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("c", F.xxhash64("text"))
    scanned = C.stored(_scanned(docs, window).select("doc_id", "c", "s.*"), "scanned")
    copies = C.stored(scanned.where(F.col("n_words") >= window).groupBy("c").agg(F.count(F.lit(1)).alias("m")), "copies")
    anchors = scanned.where(F.col("n_words") >= window).select("c", "h", "p").dropDuplicates(["c"]).select("c", F.explode(F.arrays_zip("h", "p")).alias("a")).select("c", "a.*")
    repeated = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    places = C.stored(anchors.join(repeated, "h").groupBy("c").agg(F.collect_list("p").alias("ps")), "places")
    candidates = _of(docs, places.select("c")).join(places, "c").join(copies, "c")
    regions = C.stored(_regions(candidates, window), "regions")
    key = ["anchor", "region"]
    whole = C.stored(regions.groupBy(*key).agg(F.sum("m").alias("k"), F.count(F.lit(1)).alias("n")).where("k > 1").select(*key), "whole")
    marks = regions.join(whole, key, "left_semi").where("m = 1").select("c", "s", "n")
    single = C.stored(regions.join(whole, key, "left_anti"), "single")
    # windows of repeated regions, once each, where another region with their anchor waits for them
    known = regions.join(whole, key, "left_semi").join(single.select("anchor").distinct(), "anchor", "left_semi").select("anchor", F.explode("w").alias("w")).distinct().withColumn("k", F.lit(2).cast("long"))
    windows = single.select("c", "anchor", "s", F.posexplode("w").alias("i", "w")).select("c", "anchor", "w", (F.col("s") + F.col("i")).alias("s"))
    again = windows.select("anchor", "w", F.lit(1).cast("long").alias("k")).unionByName(known).groupBy("anchor", "w").agg(F.sum("k").alias("k")).where("k > 1").select("anchor", "w")
    marks = marks.unionByName(windows.join(again, ["anchor", "w"]).select("c", "s", F.lit(1).alias("n")))
    marks = C.stored(marks.groupBy("c").agg(F.collect_list(F.struct("s", "n")).alias("marks")), "marks")
    cut = _cut(_of(docs, marks.select("c")).join(marks, "c"), window)
    cut = C.stored(cut if texts else cut.drop("kept"), "cut")
    out = scanned.select("doc_id", "c", "n_words", "sha").join(copies.where("m > 1").select("c", F.lit(True).alias("gone")), "c", "left").join(cut.withColumnRenamed("sha", "cut_sha"), "c", "left")
    gone = F.col("gone").isNotNull()
    columns = ["doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(gone, F.lit(_sha([]))).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256")]
    return out.select(*columns, *([F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_dedup(C.table(spark, sf_dir, "documents"), texts=False)


ORACLE = f"""
WITH a AS (SELECT row_number() OVER () AS i, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT i, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS p, w FROM a),
g AS (SELECT i, p, count(*) OVER (PARTITION BY list_slice(w, p, p + {WINDOW - 1})) AS n FROM t),
c AS (SELECT DISTINCT i, unnest(range(p, p + {WINDOW})) AS p FROM g WHERE n > 1),
x AS (SELECT i, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM a),
k AS (SELECT x.i, count(*) FILTER (c.p IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept FROM x LEFT JOIN c ON x.i = c.i AND x.p = c.p GROUP BY x.i)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM a LEFT JOIN k ON a.i = k.i
"""
