import itertools
import math
import random

import numpy as np
import pytest

from rankweave.llm import langid as L

PIECES = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "c", "abc"]


def brute(word, p):
    """Sum over all segmentations."""
    v = L.Vocabulary(PIECES)
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        ids = [v.id.get(x, v.unknown if len(x) == 1 else None) for x in parts]
        if None not in ids:
            total += math.prod(p[i] for i in ids)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.random((len(PIECES) + 1, 2))
    words = ["ab", "abcab", "a", "bbaab", "xab", "cabcabc"]
    s = L.Scorer(L.Vocabulary(PIECES), p)
    got = s.logs_of([L.MARK + w for w in words])
    for w, row in zip(words, got):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(brute(L.MARK + w, p[:, k])))
    long = "abc" * 50
    want = sum(s.logs_of([x])[0] for x in L.spelled([long.encode()]))
    assert s.texts([f"{long} ab\tab"])[0] == pytest.approx(want + 2 * got[0])


def test_expected_counts():
    rng = np.random.default_rng(2)
    p = rng.random(len(PIECES) + 1)
    v = L.Vocabulary(PIECES)
    lattice, n = v.lattice([L.MARK + "abab", L.MARK + "c"])
    got = L.expected(lattice, n, np.append(p, 0), np.array([2.0, 1.0]))
    h = 1e-6  # d log Z / d log p is the expected count
    for i in range(v.size):
        q = p.copy()
        q[i] *= 1 + h
        d = sum(w * (math.log(brute(x, q)) - math.log(brute(x, p))) for x, w in ((L.MARK + "abab", 2), (L.MARK + "c", 1))) / math.log(1 + h)
        assert got[i] == pytest.approx(d, abs=1e-5)


def test_many_words(monkeypatch):
    p = np.random.default_rng(3).random((len(PIECES) + 1, 2))
    texts = ["ab abc b a c", "a b", "", "abab baba cab abc ab a b c aa bb cc"]
    want = L.Scorer(L.Vocabulary(PIECES), p).texts(texts)
    monkeypatch.setattr(L, "CACHE_WORDS", 5)
    assert L.Scorer(L.Vocabulary(PIECES), p).texts(texts) == pytest.approx(want)


def test_frame(spark):
    rng = random.Random(4)
    en, de = ["the", "and", "house", "water", "with"], ["der", "und", "haus", "wasser", "mit"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(30)), "en" if i % 2 else "de", 0.5) for i in range(60)]
    rows += [(100, None, "en", 0.0), (101, "", None, 0.0), (102, "12 34 --", "de", 0.0), (103, "THE WATER", None, 0.0), (104, "und " * 20_000, None, 0.0), (105, "x" * 5000, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    pieces = L.public_pieces(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    model = L.fit(df, pieces)
    got = {r.doc_id: r for r in L.predict(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:60])
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and got[103].lang_pred == "en" and got[104].lang_pred == "de"
    none = L.fit(df.where("doc_id = 101"), pieces)
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_long_words_are_scored_whole(monkeypatch, block):
    """Segmentations across any place count, and products far below the least float have their logarithm."""
    from fractions import Fraction

    monkeypatch.setattr(L, "BLOCK", block)
    rng = np.random.default_rng(6)
    p = rng.random((len(PIECES) + 1, 2)) * 1e-4
    v = L.Vocabulary(PIECES)
    words = ["abc" * 150 + "xyab", "ba" * 25, "ab", "c" * 9]
    got = L.Scorer(v, p).logs_of([L.MARK + w for w in words])
    for w, row in zip(words, got):
        w = L.MARK + w
        for k in range(2):
            sums = [Fraction(1)]
            for e in range(1, len(w) + 1):
                ids = {s: v.id.get(w[e - s : e], v.unknown if s == 1 else None) for s in range(1, min(e, 3) + 1)}
                sums.append(sum((sums[e - s] * Fraction(p[i, k]) for s, i in ids.items() if i is not None), Fraction(0)))
            want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert row[k] == pytest.approx(want, rel=1e-9)


def test_stretches_meet_where_no_piece_spans(monkeypatch):
    """Words of many stretches, of one long stretch and longer than one step give what a pass over all their places gives."""
    rng = np.random.default_rng(8)
    p = rng.random((len(PIECES) + 1, 3)) ** 4
    v, s = L.Vocabulary(PIECES), None
    words = [L.MARK + w for w in ("ab" * 400, "abxc?cab" * 90, "日本語" * 70, "a", "?", "abc" * 30 + "??" + "ab" * 250)]
    want = [L.long_log_forward(v, w, np.vstack([p, np.zeros((1, 3))])) for w in words]
    for chars in (1 << 18, 300, 20):
        monkeypatch.setattr(L, "CHARS", chars)
        for alone in (3, 200, 10_000):
            monkeypatch.setattr(L, "ALONE", alone)
            s = L.Scorer(v, p)
            assert s.logs_of(words) == pytest.approx(np.array(want), rel=1e-9)


def test_repeated_rows_and_one_word_of_many_characters(spark):
    df = spark.createDataFrame([(1, "abc ab", "en"), (1, "abc ab", "en"), (2, "xy xy", "de"), (3, "xy" * 20_000, None), (4, None, "en")], "doc_id long, text string, lang string")
    model = L.fit(df, PIECES)
    got = [(r.doc_id, r.lang_pred) for r in L.predict(df, model).collect()]
    assert sorted(got) == [(1, "en"), (1, "en"), (2, "de"), (3, "de"), (4, "und")]
