import hashlib
import random

import numpy as np

from rankweave.llm import substring_dedup as S


def brute(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    count = {}
    for _, w in texts:
        for k in range(len(w) - window + 1):
            count[tuple(w[k : k + window])] = count.get(tuple(w[k : k + window]), 0) + 1
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def rows_for(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [some(rng.randrange(30, 90)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "a b"), (None, "x " * 40), (4, "y " * 34), (5, "z " * 35), (6, "ab cd " * 60)]
    for i in range(120):
        words = some(rng.randrange(0, 200))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((10 + i, rng.choice([" ", "\t", " \n"]).join(words)))
        if rng.random() < 0.3:
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                if copy:
                    copy[rng.randrange(len(copy))] = "new"
            rows.append((1000 + i, " ".join(copy)))
    return rows + [rows[40], rows[40], (7, rows[50][1])]


def test_same_as_brute_force(spark):
    for seed in (1, 2):
        rows = rows_for(seed)
        df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_words int").repartition(5)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.self_dedup(df).collect())
        assert got == brute(rows, S.WINDOW)
    assert S.self_dedup(df.limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200, dtype="uint64")
    b = np.concatenate([rng.integers(0, 2**63, 17, dtype="uint64"), a[40:120], rng.integers(0, 2**63, 30, dtype="uint64")])
    (ga, pa), (gb, pb) = S.Fingerprints(a).anchors(), S.Fingerprints(b).anchors()
    for k in range(80 - S.WINDOW + 1):
        assert pa[40 + k] - 40 == pb[17 + k] - 17 and ga[pa[40 + k]] == gb[pb[17 + k]]


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice("abc") for _ in range(rng.randrange(0, 14))] for _ in range(3)]
        sam = S.SuffixAutomaton()
        for t in texts:
            sam.add(t)
        grams = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
        probe = [rng.choice("abcd") for _ in range(30)]
        want = [max((n for n in range(i + 2) if tuple(probe[i + 1 - n : i + 1]) in grams), default=0) for i in range(30)]
        assert sam.matches(probe) == want


def test_reference(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda n: [f"r{rng.randrange(500)}" for _ in range(n)]
    a, b = words(60), words(50)
    monkeypatch.setattr(S, "SHARD_WORDS", 55)
    reference = spark.createDataFrame([(" ".join(a),), (" ".join(b),), (None,)], "text string")
    rows = [(1, " ".join(["x"] * 5 + a[10:50] + ["y"] + b)), (2, " ".join(a[:34])), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in S.match_reference(docs, reference).collect()}
    assert got == {1: [[5, 45], [46, 96]], 2: [], 3: [], 4: []}
