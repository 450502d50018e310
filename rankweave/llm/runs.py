"""Periodic runs of words: maximal stretches with a smallest period, by the runs theorem.

Every run has, under one of the two orders of the alphabet, a root that is the longest Lyndon word at its
start, so a text of n words has at most n runs. Longest Lyndon words are the distances to the next smaller
value of the inverse suffix array, taken for both orders. Each of these roots is extended to the right and to
the left by longest common extensions: range minima, by a sparse table, of the LCP arrays of the text and of
the reversed text. Suffix arrays come from prefix doubling, which sorts only what is still tied.

Texts are taken a few at a time, up to ``TOGETHER`` words in one set of arrays, and suffixes are ranked by
text first; a longer text has arrays of its own, about half a kilobyte a word. A text in which no window as
long as any run must repeat stands twice has no run, and leaves after the first doublings.

Results of the corner cases: null and blank texts have no words, no runs and an empty collapsed text; repeated
rows each get their row; columns beyond text pass through, and those named ``runs`` or ``collapsed`` are
replaced. Each text is worked on inside its own row, so no key gathers rows in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: A run has at least so many words, and at least so many times its period; words that share arrays.
WORDS, EXPONENT, TOGETHER = 6, 4, 1 << 18


class Suffixes:
    """Suffix order of texts laid end to end: ``word`` by position, ``end`` the end of the position's text."""

    def __init__(self, word: np.ndarray, text: np.ndarray, end: np.ndarray, rounds: int | None = None, keep: bool = False):
        """rounds: doublings at most; keep: hold the ranks of each, which ``lcp`` needs."""
        n = len(word)
        key = text * (int(word.max(initial=0)) + 1) + word
        order = np.argsort(key)
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        at = np.arange(n)
        self.end, self.levels = end, []
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
        self.tied = self._tied(order, fresh)
        step = 1
        while True:
            if keep:
                self.levels.append(self.rank.copy())
            if not len(self.tied) or rounds is not None and step >= 1 << rounds:
                return
            u = self.tied
            later = u + step
            second = np.where(later < end[u], self.rank[np.minimum(later, n - 1)] + 1, 0)
            old = self.rank[u]
            key = old * (n + 2) + second
            order = np.argsort(key)
            u, old, key = u[order], old[order], key[order]
            at, fresh, first = np.arange(len(u)), np.ones(len(u), dtype=bool), np.ones(len(u), dtype=bool)
            fresh[1:], first[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
            self.rank[u] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
            self.tied = self._tied(u, fresh)
            step *= 2

    @staticmethod
    def _tied(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        alone = fresh & np.append(fresh[1:], True)
        return order[~alone]

    def lcp(self) -> np.ndarray:
        """By rank: the words that a suffix shares with the one before it in suffix order."""
        n = len(self.rank)
        order = np.empty(n, dtype=np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[:-1], order[1:]
        shared = np.zeros(max(n - 1, 0), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + shared, b + shared
            inside = (x < self.end[a]) & (y < self.end[b])
            same = inside & (self.levels[k][np.minimum(x, n - 1)] == self.levels[k][np.minimum(y, n - 1)])
            shared += same << k
        return np.concatenate([[0], shared])[:n]


class Minima:
    """Range minima of an array by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int32)]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value from low to high, both included."""
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for level in np.unique(k).tolist():
            own = k == level
            row = self.rows[level]
            out[own] = np.minimum(row[low[own]], row[high[own] + 1 - (1 << level)])
        return out

    def next_smaller(self, end: np.ndarray) -> np.ndarray:
        """For each place the first later one, before ``end``, with a smaller value, or ``end``."""
        own = self.rows[0]
        at = np.arange(1, len(own) + 1)
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = np.flatnonzero(at + (1 << k) <= end)
            fits = fits[row[at[fits]] > own[fits]]
            at[fits] += 1 << k
        return at


def _common(ranks: np.ndarray, minima: Minima, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b, of one text and different, share."""
    x, y = ranks[a], ranks[b]
    return minima.least(np.minimum(x, y) + 1, np.maximum(x, y))


def runs_of(word: np.ndarray, sizes: np.ndarray, least_words: int = WORDS, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of texts of ``sizes`` words laid end to end, by text, start and period."""
    repeat = min(max(least_words, exponent * q) - q for q in range(1, least_words + 1))
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = begin + sizes[text]
    none = (np.zeros(0, dtype=np.int64),) * 4
    if not len(word):
        return none
    alive = np.zeros(len(sizes), dtype=bool)
    alive[text[Suffixes(word, text, end, rounds=repeat.bit_length() - 1).tied]] = True
    if not alive.any():
        return none
    if not alive.all():
        names, here = np.flatnonzero(alive), alive[text]
        found = runs_of(word[here], sizes[names], least_words, exponent)
        return (names[found[0]], *found[1:])
    n, places = len(word), np.arange(len(word))
    forth = Suffixes(word, text, end, keep=True)
    back = None
    found = []
    ahead = Minima(forth.lcp())
    for ranks in (forth.rank, Suffixes(word.max() - word, text, end).rank):
        i = places
        q = Minima(ranks).next_smaller(end) - i
        fits = i + q < end
        if exponent > 2:
            fits &= word[i] == word[np.minimum(i + q, n - 1)]
        i, q = i[fits], q[fits]
        right = _common(forth.rank, ahead, i, i + q)
        fits = right >= (exponent - 2) * q
        i, q, right = i[fits], q[fits], right[fits]
        if not len(i):
            continue
        if back is None:
            mirror = begin + end - 1 - places
            back = Suffixes(word[mirror], text, end, keep=True)
            behind = Minima(back.lcp())
        left = np.zeros(len(i), dtype=np.int64)
        inner = np.flatnonzero((i > begin[i]) & (word[i - 1] == word[i + q - 1]))
        left[inner] = _common(back.rank, behind, mirror[i[inner] - 1], mirror[i[inner] + q[inner] - 1])
        length = left + q + right
        fits = length >= np.maximum(least_words, exponent * q)
        found.append(np.stack([text[i], i - left - begin[i], length, q])[:, fits])
    if not found:
        return none
    return tuple(np.unique(np.concatenate(found, axis=1)[[0, 1, 3, 2]], axis=1)[[0, 1, 3, 2]])


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[0] + runs[2], 1)
    np.add.at(change, runs[0] + runs[1], -1)
    kept = np.cumsum(change)[:-1] == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def _group(texts: list[list[bytes]], least_words: int, exponent: int) -> Iterator[tuple[np.ndarray, bytes]]:
    number = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    word = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
    own, *rest = runs_of(word, sizes, least_words, exponent)
    cuts = np.searchsorted(own, np.arange(len(texts) + 1))
    rest = np.stack(rest)
    for k, words in enumerate(texts):
        runs = rest[:, cuts[k] : cuts[k + 1]]
        yield runs, b" ".join(_collapsed(words, runs) if runs.shape[1] else words)


def _answer(found: list[tuple[np.ndarray, bytes]]) -> pa.StructArray:
    stops = np.cumsum([0, *(r.shape[1] for r, _ in found)])
    flat = np.concatenate([r for r, _ in found], axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    runs = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["start", "length", "period"])
    texts = pa.array([t.decode() for _, t in found], pa.string())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(stops, pa.int32()), runs), texts], ["runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str | Column = "text", least_words: int = WORDS, exponent: int = EXPONENT) -> DataFrame:
    """Adds to each row ``runs``, by start and period, and ``collapsed``: the words, parted by single blanks, with one period left of each run.

    A run is a stretch of words that its smallest period q describes, of at least ``least_words`` words and
    ``exponent`` periods, an integer from 2, that neither neighbour extends. Starts are word numbers from 0.
    """
    if exponent < 2 or least_words < 1:
        raise ValueError("runs have at least 2 periods and a word")

    @F.arrow_udf("struct<runs array<struct<start bigint,length bigint,period bigint>>,collapsed string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, waiting, held = [], [], 0
            for value in batch:
                words = (value.as_py() or "").encode().split()
                if waiting and held + len(words) > TOGETHER:
                    out += _group(waiting, least_words, exponent)
                    waiting, held = [], 0
                waiting.append(words)
                held += len(words)
            yield _answer(out + list(_group(waiting, least_words, exponent)))

    column = F.col(text) if isinstance(text, str) else text
    rest = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    return docs.withColumn("__runs", found(column.cast("string"))).select(*(F.col(f"`{c}`") for c in rest), "__runs.runs", "__runs.collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties to the smaller start, then period."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # the contract's planted repeats: from word a on, the p words from a over and over
    docs = docs.withColumns({"g": F.floor(h / 10), "w": F.when(h % 10 == 0, C.words(F.col("text")))}).withColumn("n", F.size("w").cast("long"))
    docs = docs.withColumn("a", F.col("g") % F.greatest(F.col("n"), F.lit(1))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform("w", lambda _, i: F.get("w", place(i))), " ")
    found = periodic_runs(docs.select("doc_id", F.when(F.col("w").isNotNull(), planted).otherwise(F.col("text")).alias("text")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("top"), "runs", "collapsed")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length DIV top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
