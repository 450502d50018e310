"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by a pattern into pre-tokens. Each pre-token starts as single bytes; the adjacent pair
of the lowest merge rank, leftmost first, is joined until no pair has a rank. Pairs wait in buckets,
one per rank; a bitmap of three levels finds the lowest rank that has any, by find-first-set on one
word a level. Positions form a doubly linked list, and a bucket entry whose pair has changed since is
skipped when it comes up. A pre-token of n bytes takes O(n log n), however long it is.

Texts of up to ``TOGETHER`` bytes in all are encoded together. Their distinct short pre-tokens go through one
queue, thousands at a time: a popped rank merges, in each pre-token, its leftmost pair of that rank, in one
step of array operations. The ids of each are then put where it stands, also in array steps.

Results of the corner cases: a null text is an empty one; an empty text has no ids and decodes to no
bytes; text that looks like a special token is ordinary text; unknown ids stop decoding with an error.
Input columns pass through; an input column with the name of the output column is replaced.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rank file over this is refused: it is broadcast to every executor.
MAX_RANK_FILE = 64 << 20
#: Distinct short pre-tokens of the texts before that one Python worker remembers, and the most bytes of a short one.
CACHE_ENTRIES, SHORT = 100_000, 256
#: Bytes of texts that are encoded together, in some tens of times their memory; longer texts are split piece by piece.
TOGETHER = 4_000_000
#: Ids that are decoded together.
IDS = 1_000_000


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank and its lowest position."""

    BITS = 6

    def __init__(self, n_ranks: int):
        self.levels: list[list[int]] = []
        n = n_ranks
        while True:
            n = (n + 63) >> self.BITS
            self.levels.append([0] * max(n, 1))
            if n <= 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        at = rank
        for words in self.levels:
            word, bit = at >> 6, 1 << (at & 63)
            old = words[word]
            words[word] = old | bit
            if old:  # the levels above know of this word
                break
            at = word

    def pop(self) -> tuple[int, int] | None:
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        bucket = self.buckets[at]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[at]
            up = at
            for words in self.levels:
                word = up >> 6
                words[word] &= ~(1 << (up & 63))
                if words[word]:
                    break
                up = word
        return at, position


class Pieces:
    """The bytes of every id, side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        self.lengths = np.array([len(x) for x in pieces], dtype="int64")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(pieces), "u1")

    def _flat(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, and where those of each end."""
        lengths = self.lengths[np.minimum(ids, len(self.lengths) - 1)]
        if not lengths.all() or (len(ids) and ids.max() >= len(self.lengths)):
            raise ValueError("ids without a token")
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes(), ends

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        return b"".join(self._flat(ids[i : i + IDS])[0] for i in range(0, len(ids), IDS))

    def decode_array(self, packed: pa.Array) -> Iterator[pa.Array]:
        """The bytes of each row of packed ids, in arrays that follow each other."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(packed), 0)) // 4
        i = 0
        while i < len(packed):
            j = max(i + int(np.searchsorted(np.cumsum(sizes[i:], dtype="int64"), IDS, side="right")), i + 1)
            if j == i + 1:
                yield pa.array([self.decode(packed[i].as_py() or b"")], pa.binary())
            else:
                own = b"".join(x or b"" for x in packed.slice(i, j - i).to_pylist())
                data, ends = self._flat(np.frombuffer(own, "<u4"))
                stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes[i:j])])].astype("i4")
                yield pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(data)])
            i = j


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


class ByteBpe:
    """The rank table of a byte-level BPE and its pattern.

    ``cut_at_spaces`` may be set for a pattern none of whose matches has a space after its first
    character, other than matches of blanks alone, and that matches a run of ASCII letters, with a space
    before it or not, whole: a text without double spaces can then be cut before every space first.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut_at_spaces: bool = False):
        self.ranks, self.cut_at_spaces = ranks, cut_at_spaces
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self.n_ranks = max(ranks.values()) + 1
        self.cache: dict[bytes, bytes] = {}
        self.packed = {piece: i.to_bytes(4, "little") for piece, i in ranks.items()} | {b"": b""}
        self.pieces = Pieces(ranks)
        self.decode = self.pieces.decode
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype="int64")
        pairs, made = array("q"), array("q")  # every pair of tokens that make a token
        for piece, i in ranks.items():
            for k in range(1, len(piece)):
                if (x := ranks.get(piece[:k])) is not None and (y := ranks.get(piece[k:])) is not None:
                    pairs.append(x << 32 | y)
                    made.append(i)
        order = np.argsort(np.array(pairs, dtype="int64"))
        self.pairs, self.pair_ranks = np.array(pairs, dtype="int64")[order], np.array(made, dtype="int64")[order]

    @classmethod
    def parse(cls, raw: bytes, pattern: str, cut_at_spaces: bool = False) -> ByteBpe:
        return cls(ranks_of(raw), pattern, cut_at_spaces)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, get, longest, queue = len(piece), self.ranks.get, self.longest, RankQueue(self.n_ranks)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        pair = array("q", [-1]) * n  # the rank of the token at a position with the next one, as it stands
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (top := queue.pop()) is not None:
            rank, i = top
            if pair[i] != rank:
                continue  # stale: one of its tokens has been merged since
            j = after[i]
            end = after[j]
            pair[j] = -1
            after[i] = end
            if end < n:
                before[end] = i
            for left in (i, before[i]):
                if left < 0:
                    continue
                middle = after[left]
                new = None
                if middle < n and (stop := after[middle]) - left <= longest:
                    new = get(piece[left:stop])
                pair[left] = -1 if new is None else new
                if new is not None:
                    queue.push(new, left)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each of many short pre-tokens, merged in one queue."""
        if not pieces or not len(self.pairs):
            return [np.asarray(self.merge(x), "<u4").tobytes() for x in pieces]
        lengths = np.array([len(x) for x in pieces], dtype="int64")
        n = int(lengths.sum())
        word = np.repeat(np.arange(len(pieces)), lengths)
        token = np.append(self.of_byte[np.frombuffer(b"".join(pieces), "u1")], 0)
        ends = np.cumsum(lengths)
        after = np.arange(1, n + 2)
        after[ends - 1] = n  # n stands for none, on either side
        before = np.arange(-1, n)
        before[ends - lengths] = n
        pair = np.append(np.where(after[:n] < n, self._rank(token[:n], token[after[:n]]), -1), -1)
        alive = np.ones(n + 1, dtype=bool)
        queue = _Buckets(self.n_ranks)
        queue.push(pair[:n], np.arange(n))
        while (top := queue.pop()) is not None:
            rank, at = top
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                first = np.empty(len(at), dtype=bool)
                first[0] = True
                np.not_equal(word[at[1:]], word[at[:-1]], out=first[1:])
                if not first.all():  # others of a pre-token wait: a merge may bring a lower rank
                    queue.again(rank, at[~first])
                    at = at[first]
            gone = after[at]
            end = after[gone]
            pair[gone] = -1
            alive[gone] = False
            token[at] = rank
            after[at] = end
            before[end] = at
            left = before[at]
            here = np.concatenate([at[end < n], left[left < n]])
            pair[at] = -1
            pair[left] = -1
            new = self._rank(token[here], token[after[here]])
            pair[here] = new
            queue.push(new, here)
        alive[n] = False
        counts = np.bincount(word, weights=alive[:n], minlength=len(pieces)).astype("int64")
        packed = token[:n][alive[:n]].astype("<u4").tobytes()
        stops = (np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _learned(self, chunks: pa.Array) -> pa.Array:
        """Packed ids of each of distinct chunks."""
        if self.cut_at_spaces:
            whole = np.asarray(pc.match_substring_regex(chunks, "^ ?[A-Za-z]+$"))
        else:
            whole = np.ones(len(chunks), dtype=bool)
        raw = chunks.cast(pa.binary()).to_pylist()
        parts = {k: [x.encode() for x in self.pattern.findall(raw[k].decode())] for k in np.flatnonzero(~whole).tolist()}
        pieces = list(dict.fromkeys(chain((raw[k] for k in np.flatnonzero(whole).tolist()), *parts.values())))
        packed, before = self.packed.get, self.cache.get
        known = {x: packed(x) or before(x) for x in pieces}
        open_ = []
        for x in pieces:
            if known[x] is None:
                if len(x) > SHORT:
                    known[x] = np.asarray(self.merge(x), "<u4").tobytes()
                else:
                    open_.append(x)
        known.update(zip(open_, self.merge_all(open_), strict=True))
        new = {x: known[x] for x in open_ if len(known[x]) > 4}
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache = {}
        if len(new) <= CACHE_ENTRIES:
            self.cache |= new
        ids = known.__getitem__
        return pa.array([b"".join(map(ids, parts[k])) if k in parts else ids(x) for k, x in enumerate(raw)], pa.binary())

    def _together(self, lists: pa.ListArray) -> pa.Array:
        """Packed ids of texts given as lists of chunks: each distinct chunk is encoded once, and their ids are put in place."""
        coded = lists.flatten().dictionary_encode()
        ids = self._learned(coded.dictionary).take(coded.indices)
        if not len(ids):
            return pa.array([b""] * len(lists), pa.binary())
        _, starts, data = ids.buffers()
        starts = np.frombuffer(starts, "i4")[ids.offset : ids.offset + len(ids) + 1]
        ends = starts[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), data])

    def _long(self, text: str) -> bytes:
        """Piece by piece: for texts whose pieces are too many to be held at a time."""
        out, cache = [], {}
        for m in self.pattern.finditer(text):
            piece = m.group()
            if (ids := cache.get(piece)) is None:
                ids = np.asarray(self.merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= SHORT and len(cache) < CACHE_ENTRIES:
                    cache[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _group(self, texts: pa.Array) -> pa.Array:
        if not self.cut_at_spaces:
            return self._together(pa.array([self.pattern.findall(x) for x in texts.to_pylist()], pa.list_(pa.string())))
        other = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, "\0"))
        cut = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(other)), " ", "\0 "), "\0")
        rest = pa.array([["", *self.pattern.findall(x)] for x in texts.filter(other).to_pylist()], pa.list_(pa.string()))
        place = np.argsort(np.argsort(np.asarray(other), kind="stable"), kind="stable")
        return self._together(pa.concat_arrays([cut, rest])).take(pa.array(place))

    def encode_array(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Ids of each text, as little-endian unsigned 32-bit integers, in arrays that follow each other."""
        texts = pc.fill_null(texts, "")
        sizes = np.asarray(pc.binary_length(texts))
        i = 0
        while i < len(texts):
            if sizes[i] > TOGETHER:
                yield pa.array([self._long(texts[i].as_py())], pa.binary())
                i += 1
                continue
            j = max(i + int(np.searchsorted(np.cumsum(sizes[i:], dtype="int64"), TOGETHER, side="right")), i + 1)
            yield self._group(texts.slice(i, j - i))
            i = j

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        for part in self.encode_array(pa.array(texts, pa.string())):
            yield from part.to_pylist()

    def encode(self, text: str) -> bytes:
        return next(self.encode_batch([text]))


class _Buckets(RankQueue):
    """A rank queue that takes and gives whole arrays of positions."""

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks >= 0
        ranks, positions = ranks[known], positions[known]
        if len(ranks) > 64:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                self.again(rank, part)
        else:
            for rank, position in zip(ranks.tolist(), positions.tolist(), strict=True):
                if bucket := self.buckets.get(rank):
                    bucket.append(position)
                else:
                    self.again(rank, [position])

    def again(self, rank: int, positions: np.ndarray | list[int]) -> None:
        own = self.buckets.get(rank)
        if own:
            own.extend(positions if isinstance(positions, list) else positions.tolist())
            return
        self.buckets[rank] = positions if isinstance(positions, list) else positions.tolist()
        at = rank
        for words in self.levels:
            word, bit = at >> 6, 1 << (at & 63)
            old = words[word]
            words[word] = old | bit
            if old:
                break
            at = word

    def pop(self) -> tuple[int, np.ndarray] | None:
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        up = at
        for words in self.levels:
            word = up >> 6
            words[word] &= ~(1 << (up & 63))
            if words[word]:
                break
            up = word
        return at, np.array(self.buckets.pop(at))


_loaded: dict[tuple, ByteBpe | Pieces] = {}


def _table(raw: bytes, pattern: str | None, cut_at_spaces: bool = False) -> ByteBpe | Pieces:
    """One table for each worker process, whatever number of tasks it runs; without a pattern, for decoding only."""
    key = (len(raw), zlib.crc32(raw), pattern, cut_at_spaces)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(ranks_of(raw)) if pattern is None else ByteBpe.parse(raw, pattern, cut_at_spaces)
    return _loaded[key]


def _raw(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_FILE + 1)
    if len(raw) > MAX_RANK_FILE:
        raise ValueError(f"the rank file has over {MAX_RANK_FILE} bytes: {path}")
    return raw


def _joined(parts: Iterator[pa.Array]) -> pa.Array:
    parts = list(parts)
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def _encoded(bpe: ByteBpe, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The ids of all rows in order, in arrays of the texts encoded together: a worker never holds those of a whole batch."""
    for batch in batches:
        yield from bpe.encode_array(batch)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out_col: str = "ids", cut_at_spaces: bool = False) -> DataFrame:
    """Adds ``out_col``: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    ``rank_file`` is read by the driver and broadcast; its size is checked.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_raw(rank_file), pattern, cut_at_spaces))

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _encoded(_table(*shared.value), batches)

    return docs.withColumn(out_col, ids(F.col(text_col).cast("string")))


def decode(docs: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the bytes that the packed ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(_raw(rank_file))

    @F.arrow_udf("binary")
    def back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _table(shared.value, None)
        for batch in batches:
            yield from pieces.decode_array(batch)

    return docs.withColumn(out_col, back(F.col(ids_col)))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", cut_at_spaces: bool = False) -> DataFrame:
    """Adds ``ids`` and ``decoded`` as encode() and decode() would, in one pass through the Python workers."""
    shared = docs.sparkSession.sparkContext.broadcast((_raw(rank_file), pattern, cut_at_spaces))

    @F.arrow_udf("struct<ids binary, decoded binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _table(*shared.value)
        for ids in _encoded(bpe, batches):
            yield pa.StructArray.from_arrays([ids, _joined(bpe.pieces.decode_array(ids))], ["ids", "decoded"])

    return docs.withColumn("__both", both(F.col(text_col).cast("string"))).withColumns({"ids": F.col("__both.ids"), "decoded": F.col("__both.decoded")}).drop("__both")


def digests(docs: DataFrame, rank_file: str, pattern: str, cut_at_spaces: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``docs(doc_id, text)``, through round_trip()."""
    both = round_trip(docs.select("doc_id", "text"), rank_file, pattern, cut_at_spaces=cut_at_spaces).select("doc_id", "ids", "decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cut_at_spaces=True)
