import random
import re

import pytest

from rankweave.llm import minhash as M


def grams(text, size):
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = {i: grams(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_same_as_brute_force(spark, size):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    rows, i = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "É a"), (7, "é a")], 10
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        rows.append((i, " ".join(base)))
        i += 1
        for _ in range(rng.choice([0, 0, 1, 3, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, "  ".join(copy).upper()))
            i += 1
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, size, 80).collect()}
    want = brute(rows, size, 80)
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in M.near_duplicates(df, 2, 80).collect())
    assert got == [("1", 5, "1", True), ("1", 5, "1", True), ("2", 5, "2", True), ("None", 0, "None", True), ("None", 5, "None", True)]
    assert M.near_duplicates(df.limit(0), 2, 80).count() == 0


def test_chain_of_edits_without_a_common_hub(spark):
    """Each text is linked with the next few only; hubs alone would not join all."""
    words = [f"v{i}" for i in range(140)]
    rows = [(k, " ".join(words[k : k + 60])) for k in range(60)]
    want = brute(rows, 2, 80)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {k: c for k, (_, c) in want.items()} and set(got.values()) == {0}


def test_near_copies_make_few_pairs(spark, monkeypatch):
    """Copies of one text, each with edits of its own: most are linked with the text, the others with none, and hardly any two copies meet."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        copy = list(base)
        for k in rng.sample(range(120), 3 + i % 9):
            copy[k] = f"own{i}x{k}"
        rows.append((i, " ".join(copy)))
    seen = []
    kept = M.verified
    monkeypatch.setattr(M, "verified", lambda pairs, *rest: seen.append(pairs.count()) or kept(pairs, *rest))
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {k: c for k, (_, c) in brute(rows, 2, 80).items()} and len(set(got.values())) > 10
    assert sum(seen) < 8 * len(rows) < 149 * 150 // 2


def test_links_among_those_apart_from_the_hub(spark):
    """Families of copies that share edits: too far from the text they come from, near to each other."""
    rng = random.Random(18)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000 - i, " ".join(w if rng.random() > 0.02 else "x" for w in base)) for i in range(40)]
    for family in range(6):
        edits = rng.sample(range(120), 9 + family)
        for i in range(8):
            copy = [f"f{family}" if k in edits else w for k, w in enumerate(base)]
            for k in rng.sample(range(120), i % 4):
                copy[k] = rng.choice(base)
            rows.append((family * 100 + i, " ".join(copy)))
    want = brute(rows, 2, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 2):
        got = {r.doc_id: r.component_id for r in M.near_duplicates(df, 2, 80, hub_rounds=rounds).collect()}
        assert got == {k: c for k, (_, c) in want.items()}
    assert 3 < len(set(got.values())) < 40


def test_whole_sets_go_only_where_members_meet(spark):
    """Copies that share edits under one label alone have no row to send, and the others only for what two labels share."""
    x = spark.createDataFrame([(1, 10, 5, [7, 8, 9], 3, 3), (1, 11, 5, [7, 8], 2, 2), (1, 12, 6, [9, 4], 0, 1), (1, 13, 6, [4, 9], 0, 1), (2, 14, 6, [7], 1, 1)], "hub long, id long, label long, e array<long>, na int, nb int")
    got = {(r.hub, r.id): (sorted(r.a), sorted(r.b)) for r in M.meeting(x).collect()}
    assert got == {(1, 10): ([9], [9]), (1, 12): ([], [9])}


def test_differences_find_all_links_with_equal_half_hashes(spark):
    """Members whose hashes agree in the half that is compared are counted as lost, so their pair is kept."""
    high = lambda k, low: (k << 32) + low
    base = [high(1000 + i, i) for i in range(200)]
    one, two, three = ([*base[: 200 - 24], *(high(i // 4, i) for i in range(24))], [*base[: 200 - 25], *(high(i // 4, i) for i in range(24))], [*base[: 200 - 26], *(high(i // 4, i) for i in range(24))])
    sets = spark.createDataFrame([(i, sorted(h)) for i, h in enumerate([base, one, two, three])], "cls long, h array<long>")
    now = spark.createDataFrame([(1, i, i, 200, 0 if i == 0 else 5) for i in range(4)], "key long, id long, label long, size long, own long")
    got = {(int(r.a), int(r.b)) for r in M.by_differences(now, lambda ids: sets, 80).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_ids_of_many_keys_are_described_once(spark):
    """Keys that share ids have one hub, so rows of differences grow with the ids, not with their keys; members linked with that hub are pairs."""
    now = spark.createDataFrame([(key, i, i, 100, 0 if i == 7 else 5) for key in range(20) for i in range(8) if i == 7 or key % 7 in (i, (i + 1) % 7)] + [(99, 20, 20, 9, 1), (99, 21, 21, 9, 0)], "key long, id long, label long, size long, own long")
    assert sorted(map(tuple, M.spheres(now).collect())) == [*((7, i, True, i) for i in range(7)), (21, 20, True, 20)]
    chain = spark.createDataFrame([(i // 2 if i % 2 else i // 2 - k, i, i // 4, 100, 10 - i) for i in range(8) for k in (0, 1)], "key long, id long, label long, size long, own long")
    got = M.spheres(chain).collect()
    assert sorted((r.hub, r.id, r.other, r.label) for r in got) == [(7, i, i < 4, i // 4) for i in range(7)]


def test_links_with_a_hub_that_was_not_compared(spark):
    """A hub of several keys joins members that it has met under no key, and finds the links between those far from it."""
    base = list(range(1000, 1100))
    sets = [(0, base), (1, base[:96] + [1, 2, 3, 4]), (2, base[:70] + list(range(5, 35))), (3, base[:70] + list(range(5, 34)) + [99])]
    df = spark.createDataFrame([(i, sorted(h)) for i, h in sets], "cls long, h array<long>")
    now = spark.createDataFrame([(1, 0, 0, 100, 0), (1, 2, 2, 100, 5), (2, 2, 2, 100, 5), (2, 1, 1, 100, 4), (2, 3, 3, 100, 5)], "key long, id long, label long, size long, own long")
    assert {(int(r.a), int(r.b)) for r in M.by_differences(now, lambda ids: df, 80).collect()} == {(0, 1), (2, 3)}
