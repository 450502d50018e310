"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word, lower-cased and with the
vocabulary's word mark in front, has in a language the sum over all its segmentations into pieces of the
product of their probabilities; a forward pass adds them up. A text's score is the product over its words,
and the prediction is the language with the largest, with its share of all languages' products (each
language equally likely beforehand). Pieces are learned by expectation-maximisation: forward-backward
passes over a language's word counts give expected counts of pieces.

The model is fit on at most about ``PER_LANG`` documents of a language, chosen by a hash of their text, so
its cost does not grow; predictions cover every row and whole texts. The vocabulary and at most
``MAX_LANGS`` languages bound what is broadcast.

Words are split at ASCII blanks and scored whole, however long. At a boundary that no piece of the vocabulary
spans, all segmentations meet, so a word's sum is the product of the sums of its stretches between such boundaries; in
most scripts a stretch has a few characters. The forward pass takes the stretches of many words side by side,
over the pieces that really stand in them, and is scaled as it goes; a long stretch is passed through alone.
Only fitting cuts words, into parts of ``LONGEST`` characters. A character that is no piece is the unknown piece. Results of the corner cases: ``und`` with score 0 for a
null or empty text, one without a letter, and if nothing could be learned; ties go to the language first
in code point order; repeated rows each get their row; columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MARK = "▁"
#: Words, characters of words and bytes of their logarithms that a worker remembers; words fitted in one array step; characters scored in one.
CACHE_WORDS, CACHE_CHARS, CACHE_BYTES, STEP, CHARS = 400_000, 8_000_000, 64 << 20, 4000, 1 << 18
#: Characters of a word fitted in one part; of a stretch that goes alone; positions of a word without boundaries in one step; positions between scalings.
LONGEST, ALONE, BLOCK, SCALING = 40, 200, 2048, 8
#: Documents of a language that the model is fit on, about, at most; rounds of fitting; languages at most.
PER_LANG, ROUNDS, MAX_LANGS = 3000, 3, 1000
#: Added to every expected count.
SMOOTH = 0.02
_LETTER = regex.compile(r"\p{L}")


class Vocabulary:
    """Piece numbers, and the lattice of all segmentations of words.

    Substrings are found by a 64-bit polynomial hash in an open-addressed table of the pieces' hashes.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    MASK = (1 << 64) - 1

    def __init__(self, pieces: list[str]):
        self.id = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.size = len(pieces) + 1
        self.longest = max((len(p) for p in pieces), default=1)
        starts = {p[:i] for p in pieces for i in range(1, len(p))}
        self.bits = max(10, (16 * (len(pieces) + len(starts))).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype="uint64")
        self.values = np.full(1 << self.bits, self.size, dtype="int32")
        self.more = np.zeros(1 << self.bits, dtype=bool)  # whether longer pieces begin so
        self.probes = 1
        for p in starts.union(pieces):
            key = 0
            for c in p:
                key = (key * self.BASE + ord(c) + 1) & self.MASK
            slot, tries = self._slot(key), 1
            while (self.values[slot] != self.size or self.more[slot]) and self.keys[slot] != key:
                slot, tries = (slot + 1) & ((1 << self.bits) - 1), tries + 1
            if self.values[slot] != self.size or self.more[slot]:
                raise ValueError("two pieces have one hash")
            self.keys[slot], self.values[slot], self.more[slot], self.probes = key, self.id.get(p, self.size), p in starts, max(self.probes, tries)

    def _slot(self, key: int) -> int:
        return ((key * 0xD1B54A32D192ED03) & self.MASK) >> (64 - self.bits)

    def _places(self, key: np.ndarray) -> np.ndarray:
        """Slots of hashes in the table, or of others where they have none."""
        slot = ((key * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - self.bits)).astype("int64")
        open_ = np.flatnonzero((self.keys[slot] != key) & ((self.values[slot] != self.size) | self.more[slot]))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            open_ = open_[(self.keys[at] != key[open_]) & ((self.values[at] != self.size) | self.more[at])]
        return slot

    def _find(self, key: np.ndarray) -> np.ndarray:
        slot = self._places(key)
        return np.where(self.keys[slot] == key, self.values[slot], np.int32(self.size))

    def arcs(self, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of all pieces that stand in words laid end to end; end: where the word of each place ends."""
        at, key, out = np.arange(len(chars)), np.zeros(len(chars), dtype="uint64"), []
        codes = chars.astype("uint64") + np.uint64(1)
        for size in range(1, self.longest + 1):
            fits = at + size <= end[at]
            at, key = at[fits], key[fits] * np.uint64(self.BASE) + codes[at[fits] + (size - 1)]
            slot = self._places(key)
            same = self.keys[slot] == key
            piece = np.where(same, self.values[slot], np.int32(self.size))
            if size == 1:
                out.append((at, np.ones(len(at), dtype="int64"), np.where(piece == self.size, np.int32(self.unknown), piece)))
            else:
                real = np.flatnonzero(piece != self.size)
                out.append((at[real], np.full(len(real), size), piece[real]))
            on = same & self.more[slot]
            at, key = at[on], key[on]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, end, length) -> piece, or ``size`` for none; the words' lengths."""
        n = np.array([len(w) for w in words])
        most = int(n.max())
        longest = min(self.longest, most)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.arange(most) < n[:, None]
        chars = np.zeros((len(words), most), dtype="uint64")
        chars[inside] = flat.astype("uint64") + np.uint64(1)
        out = np.full((len(words), most + 1, longest + 1), self.size, dtype="int32")
        key, power = np.zeros_like(chars), 1
        for size in range(1, longest + 1):
            key = key[:, 1:] if size > 1 else key
            key = key + chars[:, : most - size + 1] * np.uint64(power)
            power = (power * self.BASE) & self.MASK
            real = inside[:, size - 1 :]
            out[:, size:, size][real] = self._find(key[real])
        single = out[:, 1:, 1]
        single[inside & (single == self.size)] = self.unknown
        return out, n


def forward(lattice: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, position, language] for ``p[piece, language]``, whose last row is 0 and stands for no piece."""
    none = len(p) - 1
    alpha = np.zeros((len(n), lattice.shape[1], p.shape[1]))
    alpha[:, 0] = 1
    for e in range(1, lattice.shape[1]):
        for size in range(1, min(e, lattice.shape[2] - 1) + 1):
            own = np.flatnonzero(lattice[:, e, size] < none)
            if len(own):
                alpha[own, e] += alpha[own, e - size] * p[lattice[own, e, size]]
    return alpha


def stretch_logs(start: np.ndarray, size: np.ndarray, piece: np.ndarray, cuts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log sums of the stretches between ``cuts``, the places, from first to last, that no arc spans."""
    length = np.diff(cuts)
    own = np.repeat(np.arange(len(length)), length)[start]
    out = np.zeros((len(length), p.shape[1]))
    single = length[own] == 1
    out[own[single]] = np.log(np.maximum(p[piece[single]], 1e-300))
    for k in np.flatnonzero(length > ALONE).tolist():
        mine = own == k
        out[k] = _alone(start[mine] - cuts[k], size[mine], piece[mine], int(length[k]), p)
    side = (length[own] > 1) & (length[own] <= ALONE)
    start, size, piece, own = start[side], size[side], piece[side], own[side]
    if not len(start):
        return out
    # a stretch has one node more than characters
    first = cuts[:-1] + np.arange(len(length))
    alpha = np.zeros((int(cuts[-1]) + len(length), p.shape[1]))
    alpha[first] = 1
    origin, target, step = start + own, start + size + own, start + size - cuts[own]
    order = np.argsort(step * (int(target.max()) + 1) + target)
    origin, target, step, piece = origin[order], target[order], step[order], piece[order]
    bounds = np.searchsorted(step, np.arange(1, int(step[-1]) + 2))
    window = np.arange(int(size.max()))  # what later pieces reach back to
    for e in range(1, len(bounds)):
        a, b = bounds[e - 1], bounds[e]
        to = target[a:b]
        begins = np.flatnonzero(np.diff(to, prepend=-1))
        alpha[to[begins]] = np.add.reduceat(alpha[origin[a:b]] * p[piece[a:b]], begins, axis=0)
        if e % SCALING == 0:
            going = np.flatnonzero((length > e) & (length <= ALONE))
            if len(going):
                nodes = first[going][:, None] + e - window[window <= e]
                held = alpha[nodes]
                out[going] += _scaled(held)
                alpha[nodes] = held
    whole = np.flatnonzero((length > 1) & (length <= ALONE))
    out[whole] += np.log(np.maximum(alpha[first[whole] + length[whole]], 1e-300))
    return out


def _alone(start: np.ndarray, size: np.ndarray, piece: np.ndarray, length: int, p: np.ndarray) -> np.ndarray:
    """Log sums of one long stretch, place by place."""
    order = np.argsort(start + size, kind="stable")
    starts, pieces = start[order].tolist(), p[piece[order]].tolist()
    bounds = np.searchsorted((start + size)[order], np.arange(length + 2)).tolist()
    languages, reach = range(p.shape[1]), int(size.max())
    sums, scale = [[1.0] * p.shape[1]], np.zeros(p.shape[1])
    for e in range(1, length + 1):
        total = [0.0] * p.shape[1]
        for k in range(bounds[e], bounds[e + 1]):
            before, weight = sums[starts[k]], pieces[k]
            total = [total[j] + before[j] * weight[j] for j in languages]
        sums.append(total)
        if e % SCALING == 0:
            held = np.array(sums[max(0, e + 1 - reach) :])
            scale += _scaled(held[None])[0]
            sums[max(0, e + 1 - reach) :] = held.tolist()
    return np.log(np.maximum(sums[-1], 1e-300)) + scale


def _scaled(window: np.ndarray) -> np.ndarray:
    """Divides sums[word, position, language] by their largest of all positions, in place; its logarithm."""
    top = window.max(axis=1)
    top[top == 0] = 1
    window /= top[:, None]
    return np.log(top)


def long_log_forward(vocabulary: Vocabulary, word: str, p: np.ndarray) -> np.ndarray:
    """Log sums of one word by blocks of positions; what a block needs of the one before is its last sums."""
    longest = vocabulary.longest
    carry, scale = np.ones((1, p.shape[1])), np.zeros(p.shape[1])
    for start in range(0, len(word), BLOCK):
        low = start - len(carry) + 1
        lattice = vocabulary.lattice([word[low : start + BLOCK]])[0][0]
        alpha = np.zeros((len(lattice), p.shape[1]))
        alpha[: len(carry)] = carry
        for e in range(len(carry), len(lattice)):
            reach = min(e, lattice.shape[1] - 1)
            ids = lattice[e, 1 : reach + 1]
            alpha[e] = (alpha[e - reach : e][::-1] * p[ids]).sum(axis=0)
            if e % SCALING == 0:
                scale += _scaled(alpha[None, max(0, e - longest + 1) : e + 1])[0]
        carry = alpha[-longest:].copy()
    return np.log(np.maximum(carry[-1], 1e-300)) + scale


def expected(lattice: np.ndarray, n: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of pieces in weighted words under one language's ``p[piece]``."""
    alpha = forward(lattice, n, p[:, None])[:, :, 0]
    beta = np.zeros_like(alpha)
    rows = np.arange(len(n))
    beta[rows, n] = 1
    for s in range(lattice.shape[1] - 2, -1, -1):
        for size in range(1, min(lattice.shape[2] - 1, lattice.shape[1] - 1 - s) + 1):
            beta[:, s] += p[lattice[:, s + size, size]] * beta[:, s + size]
    total = alpha[rows, n]
    scale = np.where(total > 0, weight / np.where(total > 0, total, 1), 0)
    out = np.zeros(len(p))
    for e in range(1, lattice.shape[1]):
        for size in range(1, min(e, lattice.shape[2] - 1) + 1):
            ids = lattice[:, e, size]
            out += np.bincount(ids, weights=alpha[:, e - size] * p[ids] * beta[:, e] * scale, minlength=len(out))
    out[-1] = 0
    return out


def parts(text: str) -> list[bytes]:
    """Words as UTF-8, lower-cased."""
    return text.lower().encode().split()


def spelled(words: list[bytes]) -> list[str]:
    """What the lattice sees of words: the whole words, with the mark."""
    mark = MARK.encode()
    return (mark + (b"\n" + mark).join(words)).decode().split("\n")


def fitted(word: str) -> list[str]:
    """What fitting sees of a word: parts of at most LONGEST characters, the first with the mark."""
    w = MARK + word
    return [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]


class Scorer:
    """Log-probabilities of words, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, p: np.ndarray):
        self.vocabulary, self.p = vocabulary, np.vstack([p, np.zeros((1, p.shape[1]))])
        self._forget()

    def _forget(self) -> None:
        self.chars = 0
        self.place: dict[bytes, int] = {}
        self.words = max(1000, min(CACHE_WORDS, CACHE_BYTES // (8 * self.p.shape[1])))
        self.logs = np.zeros((self.words + 1, self.p.shape[1]))

    def logs_of(self, spellings: list[str]) -> np.ndarray:
        out = np.zeros((len(spellings), self.p.shape[1]))
        size = np.array([len(x) for x in spellings], dtype="int64")
        i = 0
        while i < len(spellings):
            j = max(i + 1, int(np.searchsorted(np.cumsum(size[i:]), CHARS, side="right")) + i)
            out[i:j] = self._together(spellings[i:j]) if size[i] <= CHARS else self._long(spellings[i])
            i = j
        return out

    def _stretches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(ends of the words, the places that no piece spans, arcs) of words laid end to end."""
        size = np.array([len(x) for x in words], dtype="int64")
        stop = np.cumsum(size)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        start, length, piece = self.vocabulary.arcs(chars, np.repeat(stop, size))
        wide = length > 1
        spanned = np.bincount(start[wide] + 1, minlength=len(chars) + 2) - np.bincount(start[wide] + length[wide], minlength=len(chars) + 2)
        return stop, np.flatnonzero(np.cumsum(spanned)[: len(chars) + 1] == 0), (start, length, piece)

    def _together(self, words: list[str]) -> np.ndarray:
        stop, cuts, arcs = self._stretches(words)
        logs = stretch_logs(*arcs, cuts, self.p)
        return np.add.reduceat(logs, np.searchsorted(cuts, np.concatenate([[0], stop[:-1]])), axis=0)

    def _long(self, word: str) -> np.ndarray:
        """A word by parts of CHARS characters that end where no piece spans."""
        out, at = np.zeros(self.p.shape[1]), 0
        while len(word) - at > CHARS:
            _, cuts, (start, length, piece) = self._stretches([word[at : at + CHARS + self.vocabulary.longest]])
            cuts = cuts[cuts <= CHARS]
            if len(cuts) < 2:
                return out + long_log_forward(self.vocabulary, word[at:], self.p)
            own = start < cuts[-1]
            out += stretch_logs(start[own], length[own], piece[own], cuts, self.p).sum(axis=0)
            at += int(cuts[-1])
        return out + self._together([word[at:]])[0]

    def texts(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text in each language."""
        out = np.zeros((len(texts), self.p.shape[1]))
        words = [parts(t) for t in texts]
        new = list(set().union(*words).difference(self.place)) if words else []
        chars = sum(map(len, new))
        if len(self.place) + len(new) > self.words or self.chars + chars > CACHE_CHARS and self.place:
            self._forget()
            new = list(set().union(*words))
            chars = sum(map(len, new))
            if len(new) > self.words:
                if len(texts) > 1:
                    half = len(texts) // 2
                    return np.vstack([self.texts(texts[:half]), self.texts(texts[half:])])
                for i in range(0, len(words[0]), self.words // 2):  # one text of very many words
                    out[0] += self.texts([b" ".join(words[0][i : i + self.words // 2]).decode()])[0]
                return out
        if new:
            at = len(self.place)
            self.logs[at : at + len(new)] = self.logs_of(spelled(new))
            self.chars += chars
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
        get = self.place.__getitem__
        for k, own in enumerate(words):
            if own:
                out[k] = self.logs[np.fromiter(map(get, own), "int64", len(own))].sum(axis=0)
        return out


def public_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Model:
    """Languages, in code point order, and p[piece, language]."""

    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray):
        self.pieces, self.langs, self.p = pieces, langs, p


def fit(docs: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, rounds: int = ROUNDS) -> Model:
    """Learns from the rows of ``docs`` that have a language and a text."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(pieces)
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return Model(pieces, [], np.zeros((vocabulary.size, 0)))
    parts_of = spark.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in sizes.items()], "lang string, part double")
    chosen = rows.join(F.broadcast(parts_of), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("part") * (1 << 30))
    words = chosen.select("lang", F.explode(C.words(F.lower("text"))).alias("word")).groupBy("lang", "word").count()
    words = C.stored(words, "words")
    number = {k: i for i, k in enumerate(langs)}
    p = np.full((vocabulary.size, len(langs)), 1.0 / vocabulary.size)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((pieces, p))

        def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, probs = now.value
            own = Vocabulary(known)
            probs = np.vstack([probs, np.zeros((1, probs.shape[1]))])
            total = np.zeros(probs.shape)
            for f in frames:
                for lang, g in f.groupby("lang"):
                    spell = [(x, c) for w, c in zip(g.word, g["count"], strict=True) for x in fitted(w)]
                    spell.sort(key=lambda x: len(x[0]))
                    for i in range(0, len(spell), STEP):
                        lattice, n = own.lattice([x for x, _ in spell[i : i + STEP]])
                        total[:, number[lang]] += expected(lattice, n, probs[:, number[lang]], np.array([c for _, c in spell[i : i + STEP]], dtype="float64"))
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"lang": lang.astype("int32"), "piece": piece.astype("int32"), "n": total[piece, lang]})

        sums = words.mapInPandas(counted, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((vocabulary.size, len(langs)), SMOOTH)
        counts[sums.piece.to_numpy(), sums.lang.to_numpy()] += sums.n.to_numpy()
        p = counts / counts.sum(axis=0)
    return Model(pieces, langs, p)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.langs, model.p))

    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, langs, p = shared.value
        scorer = Scorer(Vocabulary(pieces), p) if langs else None
        for batch in batches:
            texts = [t if t and _LETTER.search(t) else "" for t in batch]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for i in range(0, len(texts) if scorer else 0, 500):
                logs = scorer.texts(texts[i : i + 500])
                share = np.exp(logs - logs.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                for j, best in enumerate(logs.argmax(axis=1).tolist()):
                    if texts[i + j]:
                        pred[i + j], score[i + j] = langs[best], share[j, best]
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    named.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(named, "lang_pred string, score double")
    return docs.select(*keep, udf(F.col(text_col)).alias("named")).select("*", "named.*").drop("named")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(~F.coalesce(out, F.lit(False))), public_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return predict(docs, model, keep=["doc_id", F.coalesce(out, F.lit(False)).alias("held_out")])
