import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.ByteBpe(RANKS, P.PATTERN)
CUT = bpe.ByteBpe(RANKS, P.PATTERN, cut_at_spaces=True)


def packed(text):
    ids = LIB.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_as_library(text):
    assert OURS.encode(text) == packed(text)
    assert CUT.encode(text) == packed(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aabB1' \n\t\u00a0\0.,é", max_size=60))
def test_blanks_and_cuts(text):
    assert OURS.encode(text) == packed(text) == CUT.encode(text)


def test_batches_and_full_cache(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdeé \n'sth") for _ in range(rng.randrange(300))) for _ in range(300)]
    want = [packed(t) for t in texts]
    for cut in (False, True):
        assert list(bpe.ByteBpe(RANKS, P.PATTERN, cut).encode_batch(texts)) == want
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 500)
    monkeypatch.setattr(bpe, "TOGETHER", 1000)
    for cut in (False, True):
        own = bpe.ByteBpe(RANKS, P.PATTERN, cut)
        assert list(own.encode_batch([*texts, "long text " * 300])) == [*want, packed("long text " * 300)]


def test_lower_rank_after_merge():
    """In this table a merge makes a pair of a lower rank than its own."""
    ranks = {bytes([i]): 1000 + i for i in range(256)} | {b"abc": 1, b"ab": 5, b"cab": 7, b"ca": 6}
    lib = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBpe(ranks, P.PATTERN)
    rng = random.Random(2)
    for text in ["ababcabc", "abab", *("".join(rng.choice("abc") for _ in range(40)) for _ in range(200))]:
        want = struct.pack(f"<{len(lib.encode_ordinary(text))}I", *lib.encode_ordinary(text))
        assert own.encode(text) == want
        assert struct.pack(f"<{len(own.merge(text.encode()))}I", *own.merge(text.encode())) == want


def test_long_pretokens():
    rng = random.Random(5)
    for text in ("a" * 5000, "ab" * 4000, "".join(rng.choice("abcdefgh") for _ in range(20000)), " " * 3000 + "x", "é" * 3000, "<|endoftext|>"):
        assert OURS.encode(text) == packed(text) == CUT.encode(text)


def test_queue_order():
    q = bpe.RankQueue(300_000)
    rng = random.Random(1)
    items = [(rng.randrange(300_000), i) for i in range(3000)] + [(7, i) for i in range(50)]
    for x in items:
        q.push(*x)
    out = []
    while (x := q.pop()) is not None:
        out.append(x)
    assert out == sorted(items)


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n\n1234", "x"), (3, "Hello  world\n\n1234", "x"), (4, "z" * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    for i, text, _ in rows:
        want = packed(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        plain = bpe.decode(bpe.encode(df.where(df.doc_id == i), PATH, P.PATTERN), PATH).first()
        assert (bytes(plain.ids), bytes(plain.decoded)) == (want, (text or "").encode())
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_decode_in_slices(monkeypatch):
    rng = random.Random(12)
    rows = [packed("".join(rng.choice("abcde é") for _ in range(rng.randrange(80)))) for _ in range(200)] + [None, b"", packed("long " * 100)]
    monkeypatch.setattr(bpe, "IDS", 50)
    got = [x for part in OURS.pieces.decode_array(pa.array(rows, pa.binary())) for x in part.to_pylist()]
    assert got == [LIB.decode_bytes(list(struct.unpack(f"<{len(x or b'') // 4}I", x or b""))) for x in rows]
    with pytest.raises(ValueError):
        OURS.decode(struct.pack("<I", 50_256 - 1) + b"\xff\xff\0\0")


def test_rank_file_bound(monkeypatch, spark):
    monkeypatch.setattr(bpe, "MAX_RANK_FILE", 10)
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([("a",)], "text string"), PATH, P.PATTERN)


def test_a_batch_is_encoded_and_sent_in_small_parts(monkeypatch):
    """A worker holds the ids of the texts encoded together, not of a whole batch, and what it learned stays for the next ones."""
    own = bpe.ByteBpe(RANKS, P.PATTERN, cut_at_spaces=True)
    texts = [f"zqxjk{i} vwkzq " + "a line of a text " * 60_000 for i in range(8)]
    parts = list(bpe._encoded(own, iter([pa.array(texts[:5]), pa.array([], pa.string()), pa.array(texts[5:])])))
    assert max(map(len, parts)) * len(texts[0]) <= 4_000_000 and sum(map(len, parts)) == len(texts)
    assert [x for part in parts for x in part.to_pylist()] == [packed(x) for x in texts]
    assert b" vwkzq" in own.cache
    own.encode("qqzx")
    assert {b" vwkzq", b"qqzx"} <= own.cache.keys()
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 2)
    assert own.encode("qqzz wwvk yyqj") == packed("qqzz wwvk yyqj") and len(own.cache) <= 2
