"""Language-model scoring by a weighted backoff automaton over smoothed n-grams.

The model: p(w | h) = (c(hw) + KAPPA * p(w | h')) / (c(h) + KAPPA), with h' the history without its first word
and at its end the add-half unigrams, (c + 0.5) / (N + 0.5 * (V + 1)). In the automaton, each n-gram with
a count is a state or leads to the state of its longest suffix that is one; its arc bears its smoothed log
probability, and a state's failure arc to the state of its suffix bears log(KAPPA / (c(h) + KAPPA)). One
traversal from left to right carries the state and adds up arcs, the texts of a block side by side.

The automaton of a whole corpus has no bound, so it is never broadcast. Texts are taken in blocks of about
``BLOCK`` words, whose words become numbers inside the block. Counts of words, by the words themselves, and of longer
n-grams, by 64-bit hashes, are summed over all blocks by Spark, and each block gets back the counts of its own
n-grams: the states and arcs that its texts can reach. A key stands once a block at most, so no key is hot.
Words and hashes travel in the order of their hashes, many in a row, and counts come back under their places in
that order. Two n-grams with one hash would count together; of 10^13 n-grams, one in a million would.

The order is a parameter; the query's model has bigrams.

Results of the corner cases: null and empty texts are an end alone; without training texts every word is unknown,
N is 0 and each word has probability 1; repeated rows count and score each for itself; a null ``train`` is
false; columns beyond text pass through if named in ``keep``, unless an output has their name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C

#: Longest n-grams; weight of the shorter history; words in a block, about; leading bits of their hashes by which words travel; tokens for each part of the n-grams.
ORDER, KAPPA, BLOCK, BITS, PART = 2, 500.0, 9 << 19, 8, 1 << 18
#: Numbers, in every block, of the end and of the start, and what stands for them among the words; no word is empty or blank.
END, START, MARKS = 0, 1, (b"", b" ")
OUTPUT = {"n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}


class Block:
    """Texts side by side: ``token`` numbers with a start and an end for each text, ``size`` of each with both."""

    def __init__(self, token: np.ndarray, size: np.ndarray, train: np.ndarray, words: int):
        self.token, self.size, self.train, self.words = token.astype(np.int32), size.astype(np.int64), train, words
        self.begin = np.cumsum(self.size) - self.size
        self.learns = np.repeat(train, self.size)

    def grams(self, order: int) -> list[Grams]:
        """The distinct n-grams of 2 to ``order`` words, by length."""
        out, last, here = [], self.token, np.ones(len(self.token), dtype=bool)
        for _ in range(2, order + 1):
            fits = np.zeros_like(here)
            fits[1:] = here[:-1] & (self.token[1:] != START)
            at = np.flatnonzero(fits)
            pair = last[at - 1] * np.int64(self.words) + self.token[at]
            by = np.argsort(pair)
            pair = pair[by]
            fresh = np.diff(pair, prepend=-1) != 0
            number = np.full(len(self.token), -1, dtype=np.int32)
            number[at[by]] = np.cumsum(fresh, dtype=np.int32) - 1
            pair, some = pair[fresh], at[by[fresh]]
            learned = np.bincount(number[at[self.learns[at]]], minlength=len(pair)).astype(np.int32)
            out.append(Grams((pair // self.words).astype(np.int32), (pair % self.words).astype(np.int32), last[some], learned, number))
            last, here = number, fits
        return out


class Grams:
    """n-grams by number: their history's number one length down, last word, suffix's number one length down, and count in a block's training texts.

    ``at`` has the number of the n-gram that ends at each place of the block, -1 where none does.
    """

    def __init__(self, history: np.ndarray, word: np.ndarray, suffix: np.ndarray, count: np.ndarray, at: np.ndarray):
        self.history, self.word, self.suffix, self.count, self.at = history, word, suffix, count, at


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31)))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hashes(words: list[bytes], grams: list[Grams]) -> list[np.ndarray]:
    """A 64-bit hash of each word and of each n-gram, which no block's numbering enters."""
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out, last = [of_word], of_word
    for g in grams:
        last = _mixed(last[g.history], of_word[g.word])
        out.append(last)
    return out


class Automaton:
    """States are histories, 0 the empty one. Arcs bear the numbers of the n-grams that they complete, by length."""

    def __init__(self, words: int, totals: np.ndarray, grams: list[Grams], counts: list[np.ndarray], tokens: int, types: int, kappa: float):
        """totals: counts of words; counts: of ``grams``; both over all training texts."""
        p = (totals + 0.5) / (tokens + 0.5 * (types + 1))
        known = totals > 0
        known[END] = False
        self.start = START + 1 if totals[START] else 0
        state = np.where(known, np.arange(words) + 1, 0)  # of each history one word long, then of longer ones
        self.root, self.after_root = np.log10(p), state
        back, fail = [np.zeros(1), np.log10(kappa / (totals + kappa))], [np.zeros(1, dtype=np.int64), np.zeros(words, dtype=np.int64)]
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # for each length: whether there is one, its log probability, its state
        held, total = totals, words + 1
        for length, (g, c) in enumerate(zip(grams, counts, strict=True), 2):
            p = (c + kappa * p[g.suffix]) / (held[g.history] + kappa)
            after = state[g.suffix]
            if length <= len(grams):
                back.append(np.log10(kappa / (c + kappa)))
                fail.append(after)
                after = np.where((c > 0) & (g.word != END), np.arange(len(c)) + total, after)
                total += len(c)
            self.arcs.append((c > 0, np.log10(p), after))
            state, held = after, c
        self.back, self.fail = np.concatenate(back), np.concatenate(fail)
        self.depth = np.repeat(np.arange(len(back)), [len(x) for x in back])

    def step(self, state: np.ndarray, word: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(state, log probability) after one word from each state, over failure arcs where no arc has the word; grams: the numbers of the n-grams that the word would complete, by length."""
        gained, state = np.zeros(len(word)), state.copy()
        open_ = np.arange(len(word))
        for depth in range(len(self.arcs), 0, -1):
            here = self.depth[state[open_]] == depth
            u, rest = open_[here], open_[~here]
            there, value, after = self.arcs[depth - 1]
            g = grams[depth - 1][u]
            hit = there[g]
            u, missed, g = u[hit], u[~hit], g[hit]
            gained[u] += value[g]
            state[u] = after[g]
            gained[missed] += self.back[state[missed]]
            state[missed] = self.fail[state[missed]]
            open_ = np.concatenate([rest, missed])
        gained[open_] += self.root[word[open_]]
        state[open_] = self.after_root[word[open_]]
        return state, gained

    def scores(self, block: Block, grams: list[Grams]) -> np.ndarray:
        """Log10 probability of each text."""
        order = np.argsort(-block.size, kind="stable")
        begin, size = block.begin[order], block.size[order]
        state, total = np.full(len(order), self.start, dtype=np.int64), np.zeros(len(order))
        running = len(order) - np.searchsorted(size[::-1], np.arange(1, int(size.max(initial=1))), side="right")
        for t, k in enumerate(running.tolist(), 1):  # the first k texts have a token t
            at = begin[:k] + t
            state[:k], gained = self.step(state[:k], block.token[at], [g.at[at] for g in grams])
            total[:k] += gained
        out = np.empty(len(order))
        out[order] = total
        return out


CODEC = dict(codec="zstd", compression_level=6)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, their lowest bytes first, then the next, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec(CODEC["codec"], CODEC["compression_level"]).compress(planes.tobytes(), asbytes=True)


def _planes(keys: np.ndarray) -> bytes:
    """Rising numbers of 64 bits: their steps, lowest bytes first, then the next, so that what is common compresses."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _unpacked(raw: pa.Buffer, count: int) -> np.ndarray:
    planes = pa.decompress(raw, count * 4, CODEC["codec"], asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(docs: DataFrame, rows: T.StructType) -> DataFrame:
    """One row a block: its words, the token numbers, which follow the words' frequency in it, sizes, train flags and the texts' other columns."""

    def made(part: int, number: int, index: dict, tokens: list, sizes: list, train: list, rest: list) -> pa.RecordBatch:
        token = np.concatenate(tokens)
        seen = np.bincount(token, minlength=len(index) + len(MARKS))[len(MARKS) :]
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(seen) + len(MARKS), dtype=np.uint32)
        rank[: len(MARKS)] = np.arange(len(MARKS))
        rank[order + len(MARKS)] = np.arange(len(seen)) + len(MARKS)
        known = list(index)
        words = b"\n".join(known[i] for i in order.tolist())
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        packed = pa.Codec(CODEC["codec"], CODEC["compression_level"]).compress(words, asbytes=True)
        fields = [[(part << 32) + number], [len(known)], [len(words)], [packed], [_packed(rank[token])]]
        fields = [pa.array(f, t) for f, t in zip(fields, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        fields += [one(pa.array(sizes, pa.int64())), one(pa.array(train, pa.bool_())), one(pa.concat_arrays(rest))]
        return pa.RecordBatch.from_arrays(fields, ["block", "n_words", "bytes", "words", "token", "size", "train", "docs"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        fresh = lambda: (defaultdict(count(len(MARKS)).__next__), [], [], [], [])
        index, tokens, sizes, train, rest = fresh()
        held = 0
        for batch in batches:
            first = 0
            texts, flags, other = batch.column("__text"), batch.column("__train").to_pylist(), batch.column("docs")
            for i in range(len(texts)):
                words = (texts[i].as_py() or "").encode().lower().split()
                token = np.empty(len(words) + 2, dtype=np.uint32)
                token[0], token[-1] = START, END
                token[1:-1] = np.fromiter(map(index.__getitem__, words), dtype=np.uint32, count=len(words))
                tokens.append(token)
                sizes.append(len(token))
                train.append(bool(flags[i]))
                held += len(token)
                if held >= BLOCK:
                    yield made(part, number, index, tokens, sizes, train, [*rest, other.slice(first, i + 1 - first)])
                    index, tokens, sizes, train, rest = fresh()
                    held, number, first = 0, number + 1, i + 1
            if first < len(texts):
                rest.append(other.slice(first))
        if held:
            yield made(part, number, index, tokens, sizes, train, rest)

    schema = T.StructType.fromDDL("block bigint, n_words bigint, bytes bigint, words binary, token binary, size array<bigint>, train array<boolean>").add("docs", T.ArrayType(rows))
    return C.stored(docs.mapInArrow(gathered, schema), "blocks")


def _opened(row: dict[str, pa.Scalar]) -> tuple[Block, list[bytes]]:
    """A block and its words."""
    size = row["size"].values.to_numpy()
    joined = pa.decompress(row["words"].as_buffer(), row["bytes"].as_py(), CODEC["codec"], asbytes=True) if row["bytes"].as_py() else b""
    words = [*MARKS, *(joined.split(b"\n") if row["n_words"].as_py() else [])]
    return Block(_unpacked(row["token"].as_buffer(), int(size.sum())), size, row["train"].values.to_numpy(zero_copy_only=False), len(words)), words


def _in_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of hashes, in it the first place of each group of those with equal leading bits and the end, and these bits."""
    order = np.argsort(key, kind="stable")
    part = (key[order] >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return order, np.append(first, len(order)), part[first]


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Scalar]]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i] for c in batch.schema.names}


def _sent(part: np.ndarray, block: int, before: int, items: pa.Array, counts: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(counts.astype(np.int32)))
    fields = [pa.array(part), pa.array([block] * len(part), pa.int64()), pa.array((before + cut[:-1]).astype(np.int32)), items, lists]
    return pa.RecordBatch.from_arrays(fields, ["part", "block", "start", "items", "counts"])


def _word_totals(blocks: DataFrame) -> DataFrame:
    """(block, at, c, types): lists of the places of a block's words and of their counts in all training texts, if any, and the number of words of which the block is the first."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in _rows(b)):
            block, words = _opened(row)
            order, cut, part = _in_order(hashes(words, [])[0], BITS)
            texts = [b"\n".join(words[i] for i in order[a:b].tolist()).decode() for a, b in pairwise(cut.tolist())]
            counts = np.bincount(block.token[block.learns], minlength=len(words))[order]
            yield _sent(part, row["block"].as_py(), 0, pa.array(texts, pa.string()), counts, cut)

    sent = blocks.mapInArrow(emitted, "part int, block bigint, start int, items string, counts array<int>").repartition("part")
    each = sent.select("part", "block", "start", F.posexplode(F.arrays_zip(F.split("items", "\n").alias("word"), F.col("counts").alias("c"))).alias("i", "w"))
    by = W.Window.partitionBy("part", "word")
    each = each.select("part", "block", (F.col("start") + F.col("i")).alias("at"), F.col("w.word").alias("word"), F.col("w.c").alias("c"))
    each = each.withColumns({"total": F.sum("c").over(by), "least": F.min("block").over(by)}).where("total > 0")
    mine = (F.col("block") == F.col("least")) & (F.col("word") != MARKS[START].decode())
    lists = each.groupBy("part", "block").agg(F.collect_list(F.struct("at", "total")).alias("x"), F.count_if(mine).alias("types"))
    return C.stored(lists.select("block", F.col("x.at").alias("at"), F.col("x.total").alias("c"), "types"), "words")


def _gram_totals(blocks: DataFrame, order: int) -> DataFrame:
    """(block, at, c): lists of the places of a block's n-grams, in steps, and of their counts in all training texts, where these are more than the block's own.

    Hashes are cut, by their leading bits, into parts of about PART n-grams of all blocks. A block sends a row for each
    part that it has n-grams of, so at most as many rows as n-grams.
    """
    every = blocks.select(F.sum(F.aggregate("size", F.lit(0).cast("bigint"), lambda a, n: a + n))).first()[0] or 0
    bits = max(BITS, (every // PART).bit_length())

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in _rows(b)):
            block, words = _opened(row)
            grams = block.grams(order)
            before = 0
            for key, g in zip(hashes(words, grams)[1:], grams, strict=True):
                by, cut, part = _in_order(key, bits)
                key = key[by]
                items = pa.array([_planes(key[a:b]) for a, b in pairwise(cut.tolist())], pa.binary())
                yield _sent(part, row["block"].as_py(), before, items, g.count[by], cut)
                before += len(key)

    def summed(part: pa.Table) -> pa.Table:
        own = part["counts"].combine_chunks()
        size, own = np.diff(own.offsets.to_numpy()), own.flatten().to_numpy()
        key = np.concatenate([_keys(x) for x in part["items"].to_pylist()])
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        at = part["start"].to_numpy()[row] + np.arange(len(key)) - begin[row]
        by = np.argsort(key)
        fresh = np.diff(key[by], prepend=~key[by[:1]]) != 0
        total = np.empty(len(key), dtype=np.int64)
        total[by] = np.add.reduceat(own[by].astype(np.int64), np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        kept = np.flatnonzero(total > own)
        at, row = at[kept], row[kept]
        step = np.diff(at, prepend=0)
        new = np.diff(row, prepend=-1) != 0
        step[new] = at[new]
        stops = pa.array(np.searchsorted(row, np.arange(len(size) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(stops, pa.array(x)) for x in (step.astype(np.int32), total[kept])]
        return pa.table({"block": part["block"].combine_chunks(), "at": lists[0], "c": lists[1]})

    sent = blocks.mapInArrow(emitted, "part int, block bigint, start int, items binary, counts array<int>")
    return sent.groupBy("part").applyInArrow(summed, "block bigint, at array<int>, c array<bigint>").where(F.size("at") > 0)


def lm_score(docs: DataFrame, train: Column, text_col: str = "text", keep: Sequence[str] = ("doc_id",), order: int = ORDER, kappa: float = KAPPA) -> DataFrame:
    """``keep`` and, for each text, n_tokens, n_known, train_tokens, base_score (by words alone) and score, of a model learned from the rows where ``train``.

    Tokens are the words, A-Z in lower case, and an end.
    """
    if order < 1 or not kappa > 0:
        raise ValueError("the order is at least 1, kappa above 0")
    keep = [c for c in keep if c.lower() not in OUTPUT]
    inner = [f"c{i}" for i in range(len(keep))]
    own = docs.select(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)) if keep else [F.lit(0).alias("none")]).alias("docs"), F.col(f"`{text_col}`").cast("string").alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"))
    rows = own.schema["docs"].dataType
    blocks = _blocks(own, rows)
    words = _word_totals(blocks)
    types = words.agg(F.sum("types")).first()[0] or 0
    tokens = blocks.select(F.sum(F.aggregate(F.zip_with("size", "train", lambda n, t: F.when(t, n - 1).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    counted = words.select("block", "at", "c", F.lit(True).alias("word"))
    if order > 1:
        counted = counted.unionByName(_gram_totals(blocks, order).withColumn("word", F.lit(False)))

    def scored(block: pa.Table, counted: pa.Table) -> pa.Table:
        columns = list(map(block.column, range(block.num_columns)))
        rows = [dict(zip(block.column_names, (c[i] for c in columns), strict=True)) for i in range(len(block))]
        out = [pa.table({**dict(zip(inner, row["docs"].values.flatten(), strict=False)), **_scored(row, counted, order, kappa, tokens, types)}) for row in rows]
        return pa.concat_tables(out) if out else schema_of_none

    schema = T.StructType([*(f for f in rows.fields if keep), *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in OUTPUT.items())).fields])
    schema_of_none = to_arrow_schema(schema).empty_table()
    out = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(scored, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(inner, keep, strict=True)), *OUTPUT)


def _lists(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and counts of all rows' lists, none of them empty, and the first place of each list."""
    at, c = rows["at"].combine_chunks(), rows["c"].combine_chunks()
    size = np.diff(at.offsets.to_numpy())
    return at.flatten().to_numpy().astype(np.int64), c.flatten().to_numpy(), np.cumsum(size) - size


def _scored(row: dict[str, pa.Scalar], counted: pa.Table, order: int, kappa: float, tokens: int, types: int) -> dict[str, pa.Array]:
    """The figures of a block's texts."""
    block, words = _opened(row)
    grams = block.grams(order)
    key = hashes(words, grams)
    totals = np.zeros(len(words), dtype=np.int64)
    at, c, _ = _lists(counted.filter(counted["word"]))
    totals[_in_order(key[0], BITS)[0][at]] = c
    step, c, first = _lists(counted.filter(pc.invert(counted["word"])))
    at = np.cumsum(step)
    at -= np.repeat((at - step)[first], np.diff(np.append(first, len(at))))
    counts, before = [], 0
    for h, g in zip(key[1:], grams, strict=True):
        total = g.count.astype(np.int64)
        own = (at >= before) & (at < before + len(h))
        total[_in_order(h, BITS)[0][at[own] - before]] = c[own]
        counts.append(total)
        before += len(h)
    del key, at, c, step
    automaton = Automaton(block.words, totals, grams, counts, tokens, types, kappa)
    read = block.token != START
    text = np.repeat(np.arange(len(block.size)), block.size)[read]
    base = np.bincount(text, weights=automaton.root[block.token[read]], minlength=len(block.size))
    known = np.bincount(text, weights=totals[block.token[read]] > 0, minlength=len(block.size)).astype(np.int64)
    figures = [block.size - 1, known, np.full(len(block.size), tokens, dtype=np.int64), base, automaton.scores(block, grams)]
    return {c: pa.array(f) for c, f in zip(OUTPUT, figures, strict=True)}


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    return lm_score(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))
