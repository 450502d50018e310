import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import lm_score as L
from rankweave.llm import queries

DIR = "/root/testdata/sf0.001"


def direct(texts, train, order, kappa=L.KAPPA):
    """(n_tokens, n_known, base, score) of each text, from dictionaries of counts, by the model's recursion."""
    streams = [["<s>", *(t or "").encode().lower().split(), "</s>"] for t in texts]
    counts = Counter(tuple(s[i : i + k]) for s, own in zip(streams, train) if own for k in range(1, order + 1) for i in range(len(s) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",))
    types = sum(len(g) == 1 and g != ("<s>",) for g in counts)

    def p(history, word):
        if not history:
            return (counts[word,] + 0.5) / (n + 0.5 * (types + 1))
        return (counts[*history, word] + kappa * p(history[1:], word)) / (counts[history] + kappa)

    out = []
    for s in streams:
        words = s[1:]
        score = sum(math.log10(p(tuple(s[max(0, i + 1 - order + 1) : i + 1]), w)) for i, w in enumerate(words))
        out.append((len(words), sum(counts[w,] > 0 for w in words), sum(math.log10(p((), w)) for w in words), score))
    return n, out


def some_texts():
    rng = random.Random(4)
    words = ["The", "the", "cat", "sat", "é", "x" * 50, "on", "mat.", "0"]
    texts = [" ".join(rng.choice(words[: rng.randrange(1, 10)]) for _ in range(rng.choice([1, 3, 9, 40]))) for _ in range(60)]
    return [*texts, *texts[:9], None, "", " \n\t ", "all of it unseen", "the cat sat " * 3000]


@pytest.mark.parametrize("order,block", [(1, 1 << 22), (2, 1 << 22), (2, 50), (3, 200), (4, 1)])
def test_against_dictionaries(spark, monkeypatch, order, block):
    monkeypatch.setattr(L, "BLOCK", block)
    texts = some_texts()
    train = [i % 3 != 1 and t != "all of it unseen" for i, t in enumerate(texts)]
    rows = [(i, t, own if own else None if i % 2 else False, "x", 3) for i, (t, own) in enumerate(zip(texts, train))]
    df = spark.createDataFrame(rows, "doc_id long, text string, own boolean, score string, block int").repartition(5)
    got = L.lm_score(df, F.col("own"), keep=("doc_id", "block", "score"), order=order).collect()
    n, want = direct(texts, train, order)
    assert sorted(r.doc_id for r in got) == list(range(len(texts))) and {r.block for r in got} == {3}
    for r in got:
        tokens, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_probabilities_sum_to_one():
    """Over all words and one that was never seen, from every state."""
    token = np.array([1, 2, 3, 2, 4, 0, 1, 3, 2, 0, 1, 5, 0])
    block = L.Block(token, np.array([6, 4, 3]), np.array([True, True, False]), 6)
    grams = block.grams(3)
    totals = np.array([2, 2, 3, 2, 1, 0])
    a = L.Automaton(6, totals, grams, [g.count for g in grams], 8, 4, 2.0)
    none = len(grams[0].word)  # a number for n-grams that never stood
    a.arcs[0] = tuple(np.append(x, 0) for x in a.arcs[0])
    a.arcs[0] = (a.arcs[0][0].astype(bool), *a.arcs[0][1:])
    for state, after in [(0, {}), *((u + 1, {w: k for k, (h, w) in enumerate(zip(grams[0].history, grams[0].word)) if h == u}) for u in (1, 2, 3, 4))]:
        total = 0.0
        for w in (0, 2, 3, 4, 5):
            total += 10 ** a.step(np.array([state]), np.array([w]), [np.array([after.get(w, none)]), np.array([0])])[1][0]
        assert total == pytest.approx(1)


def test_corner_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.lm_score(none, F.lit(True)).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None), (None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.lm_score(some, F.lit(False)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score, got[1].score) == (3, 0, 0, 0.0, 0.0) and got[2].n_tokens == 1 and None in got
    with pytest.raises(ValueError):
        L.lm_score(some, F.lit(True), kappa=0)


def test_query(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    n, want = direct([r.text for r in rows], [not h for h in held], L.ORDER)
    df = queries.QUERIES["op13_lm_score"](spark, DIR)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert [t for _, t in df.dtypes] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows)
    for (doc_id, _), out, (tokens, known, base, score) in zip(rows, held, want):
        r = got[doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, tokens, known, n)
        assert (r.base_score, r.score) == pytest.approx((base, score))
