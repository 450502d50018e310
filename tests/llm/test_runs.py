import hashlib
import random
import zlib

import numpy as np
import pytest

from rankweave.llm import queries
from rankweave.llm import runs as R

DIR = "/root/testdata/sf0.001"


def brute(w, least=6, exponent=4):
    """Every maximal stretch for every period, if no smaller period describes it."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                length = i - start + q
                if length >= max(least, exponent * q) and not any(all(w[start + x] == w[start + x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_texts(rng):
    out = []
    for _ in range(rng.randrange(1, 6)):
        letters, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 20, 60])
        text = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.4:
            a, p = rng.randrange(n), rng.randrange(1, n + 1)
            text = [x if i < a else text[a + (i - a) % min(p, n - a)] for i, x in enumerate(text)]
        out.append(text)
    return out


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3), (1, 2)])
def test_against_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(200):
        texts = some_texts(rng)
        sizes, word = np.array([len(t) for t in texts]), np.array([x for t in texts for x in t], dtype=np.int64)
        got = list(zip(*(x.tolist() for x in R.runs_of(word, sizes, least, exponent)), strict=True))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t, least, exponent)]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "TOGETHER", 9)
    texts = [None, "", " \t\n", "a", "x a b\na b  a b a b y", "a a a a a a", "a a a a a", "x a b\na b  a b a b y", "é é " * 30, "w " * 200_000]
    df = spark.createDataFrame([(i, t, "own", 5) for i, t in enumerate(texts)], "doc_id long, text string, runs string, RUNS_2 int")
    got = {r.doc_id: r for r in R.periodic_runs(df).collect()}
    assert len(got) == len(texts) and got[0].RUNS_2 == 5
    assert all(got[i].runs == [] for i in (0, 1, 2, 3, 6)) and [got[i].collapsed for i in (0, 1, 2, 3, 6)] == ["", "", "", "a", "a a a a a"]
    assert [tuple(r) for r in got[4].runs] == [(1, 8, 2)] and got[4].collapsed == "x a b y" and got[7].runs == got[4].runs
    assert [tuple(r) for r in got[5].runs] == [(0, 6, 1)] and got[5].collapsed == "a"
    assert got[8].collapsed == "é é" and [tuple(r) for r in got[9].runs] == [(0, 200_000, 1)]
    assert R.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(df, exponent=1)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, DIR).collect()}
    assert len(got) == len(rows)
    several = 0
    for doc_id, text in rows:
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        several += len(runs) > 0
    assert several >= 5
    assert [t for _, t in queries.QUERIES["op11_periodic_runs"](spark, DIR).dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_no_id(spark, tmp_path):
    spark.createDataFrame([(None, "a a a a a a a"), (7, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert (got[None].n_runs, got[None].length, got[7].n_runs, got[7].start) == (1, 7, 0, None)
    assert got[7].runs_sha256 == got[7].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
