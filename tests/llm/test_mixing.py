import random

import numpy as np

from rankweave.llm import mixing as M


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 12)
        sizes = [rng.choice([0, rng.randrange(1, 1000)]) for _ in range(n)]
        weights = M.cycle_weights([None] * n)
        t = M.targets(sizes, weights, 1.5, 2.0)
        assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))
        assert all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes))
        free = [x / w for x, w, s in zip(t, weights, sizes) if x < 2 * s - 1e-9]
        assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_permutation():
    for n in (1, 2, 3, 7, 64, 100, 1000, 4097):
        p = M.Permutation(n, 12345 + n)
        x = p(np.arange(n))
        assert sorted(x.tolist()) == list(range(n))
        assert (p.inverse(x) == np.arange(n)).all()


def test_slots_come_to_target():
    rng = random.Random(2)
    for _ in range(500):
        size, block = rng.randrange(1, 500), rng.choice([1, 3, 8, 128])
        target = rng.uniform(0, 2 * size)
        key = lambda turn: 99 + turn
        n, last = M.slots_for(size, target, block, key)
        blocks = -(-size // block)
        total = 0
        for j in range(n):
            b = int(M.Permutation(blocks, key(j // blocks))(np.array([j % blocks]))[0])
            full = min(block, size - b * block)
            total += last if j == n - 1 else full
            assert 0 < last and (j < n - 1 or last <= full)
        assert total == round(target)


def table(spark, seed=0, n=300):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.05 else "w " * rng.choice([0, 1, 5, 60, 400]), rng.choice(["a", "b", "hot", "hot", "hot", None, "tiny"]) if i else "once", i) for i in range(n)]
    rows += [(7, "x y z", "a", 0)] * 3 + [(None, "x y", "b", 0), (900, "", "empty", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int"), rows


def test_taken(spark):
    df, rows = table(spark)
    got = M.taken(df).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r["size"], str(r.source)) for r in got) == sorted((str(i), len((t or "").split()), str(s)) for i, t, s, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = M.targets([sum(r["size"] for r in by[s]) for s in names], M.cycle_weights(names), 1.5, 2.0)
    for s, t in zip(names, want):
        assert abs(by[s][0].target - t) < 1e-6
        assert abs(sum(r.taken for r in by[s]) - t) <= 1
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, M.taken(df.repartition(7)).collect()))
    assert M.taken(df.limit(0)).count() == 0


def test_slots_are_filled_once(spark):
    df, _ = table(spark, 3)
    spans = M.mixture(df, block=16).where("slot IS NOT NULL").collect()
    slots = {}
    for r in spans:
        slots.setdefault((r.shard, r.slot), []).append(r)
    assert sorted(slots) == [(i // M.SHARD, i % M.SHARD) for i in range(len(slots))]
    for own in slots.values():
        assert len({(r.source, r.turn) for r in own}) == 1 and sum(r.n for r in own) <= 16


def test_drawn_words_come_to_target(spark):
    df, rows = table(spark, 5)
    rows = [(i, t, s) for i, t, s, _ in rows] + [(5000, "Long  text\n" * 20_000, "one long"), (5001, "u v w " * 3000, "hot"), (None, "null " * 90, "nulls"), (None, "else " * 90, "nulls"), (None, "else " * 90, "nulls")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, came = {}, {}
    for r in M.taken(df).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    whole, cut = {(i, t, s) for i, t, s in rows}, {}
    got = M.drawn(df).collect()
    for r in got:
        came[r.source] = came.get(r.source, 0) + len(r.text.split())
        if tuple(r) not in whole:
            cut[r.source] = cut.get(r.source, 0) + 1
            assert any(i == r.doc_id and s == r.source and t and t.startswith(r.text) for i, t, s in rows)
    assert all(abs(came.get(s, 0) - n) <= M.BLOCK for s, n in taken.items())
    assert max(cut.values(), default=0) <= 1 and "nulls" in came
    assert sorted(map(str, got)) == sorted(map(str, M.drawn(df.repartition(7)).collect()))
    assert M.drawn(df.limit(0)).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([(" a  b\n\nc d ", n) for n in (1, 2, 3, 4)], "t string, n long")
    got = [r[0] for r in df.select(M.first_words(df.t, df.n)).collect()]
    assert got == ["a", "a  b", "a  b\n\nc", "a  b\n\nc d"]
