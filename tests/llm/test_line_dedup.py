import random

import pytest
from pyspark.sql import functions as F

from rankweave.llm import _common as C
from rankweave.llm import line_dedup as L


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def change(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        match rng.randrange(3):
            case 0:
                text.insert(at, rng.choice("abcé"))
            case 1 if text and at < len(text):
                del text[at]
            case _ if at < len(text):
                text[at] = rng.choice("abcé")
    return "".join(text)


@pytest.mark.parametrize("tau", [0, 1, 2, 3, 5])
def test_banded_distance(spark, tau):
    rng = random.Random(tau)
    pairs = []
    for _ in range(250):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(tau + 1, 40)))
        pairs.append((a, max(change(rng, a, rng.randrange(0, tau + 3)), "abcabc"[: tau + 1], key=len)))
    got = {(r.ta, r.tb) for r in L.verified(spark.createDataFrame(pairs, "ta string, tb string"), tau).collect()}
    assert got == {(a, b) for a, b in pairs if edits(a, b) <= tau}


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_candidates_are_complete(spark, tau):
    rng = random.Random(10 + tau)
    rows = []
    for i in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(tau + 1, 25)))
        b = change(rng, a, rng.randrange(0, tau + 1))
        if len(b) > tau:
            rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    some = lambda c: F.array(*L.keys(F.col(c), tau))
    assert df.where(~F.arrays_overlap(some("a"), some("b"))).count() == 0


def brute(rows, tau, least):
    at = [(i, k, x.strip(" \t\n\x0b\f\r")) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    at = sorted(((i is not None, i or 0, k), x) for i, k, x in at if len(x) >= least)
    texts = sorted({x for _, x in at})
    up = {x: x for x in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            if abs(len(a) - len(b)) <= tau and edits(a, b) <= tau:
                up[root(b)] = root(a)
    seen, gone = set(), set()
    for place, x in at:
        if root(x) in seen:
            gone.add(place)
        seen.add(root(x))
    return gone


@pytest.mark.parametrize("tau", [1, 2])
def test_same_as_brute_force(spark, tau):
    rng = random.Random(20 + tau)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(8, 60))) for _ in range(25)]
    rows = [(None, base[0]), (0, None), (1, ""), (2, "\n\n"), (3, "short\nshort"), (4, "x" * 5000 + "\n" + "x" * 5001)]
    rows += [(10 + i, "\n".join(change(rng, rng.choice(base), rng.choice([0, 0, 0, 1, 2, 4])) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "e", 5) for i, t in rows], "doc_id long, text string, lang string, id int")
    got = {r.doc_id: r for r in L.dedup(df, tau, 20).collect()}
    gone = brute(rows, tau, 20)
    assert gone and len(got) == len(rows)
    for i, t in rows:
        kept = t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i is not None, i or 0, k) not in gone)
        assert (got[i].text, got[i].lang, got[i].id) == (kept, "e", 5)
        assert (got[i].n_lines, got[i].n_removed) == ((len(t.split("\n")), sum(p[:2] == (i is not None, i or 0) for p in gone)) if t is not None else (0, 0))
    assert L.dedup(df.limit(0), tau).count() == 0


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, "a line of twenty characters\na line of twenty charactersx")], "doc_id long, text string")
    out = L.dedup(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().n_removed == 1


@pytest.mark.parametrize("tau", [1, 2])
def test_linkable_loses_no_line(spark, tau):
    rng = random.Random(30 + tau)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(20, 50))) for _ in range(40)]
    texts = sorted({x for b in base for x in (b, change(rng, b, rng.randrange(0, tau + 1)), change(rng, b, 12)) if len(x) >= 20})
    near = {i for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and abs(len(a) - len(b)) <= tau and edits(a, b) <= tau}
    got = {r.id for r in L.linkable(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), tau).collect()}
    assert near and near <= got and len(got) < len(texts)


def test_one_edit_makes_few_pairs(spark):
    rng = random.Random(40)
    start, end = "a line that many pages show, as of ", " at the latest, all times local"
    texts = {start + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)) + end for _ in range(250)}
    texts |= {start + "mm" + x + "mmmmm" + end for x in "abcdefgh"} | {start + "mmxmmmmmm" + end, start + "mmmmmmm" + end}
    df = spark.createDataFrame(list(enumerate(sorted(texts))), "id long, t string")
    by_id = {i: x[len(start) : -len(end)] for i, x in enumerate(sorted(texts))}
    pairs = {tuple(sorted(r)) for r in L.one_edit(df).collect()}
    near = {(i, j) for i in by_id for j in by_id if i < j and edits(by_id[i], by_id[j]) <= 1}
    assert near and pairs <= near and len(pairs) < 30
    groups = {r.node: r.component for r in C.components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert all(groups[i] == groups[j] for i, j in near)


def test_rows_of_one_doc_id(spark):
    rows = [(1, "the first text's own line\na line that both texts hold"), (1, "the other text's own line\na line that both texts hold"), (1, "the other text's own line\na line that both texts hold"), (2, "a line that both texts hold")]
    got = sorted((r.doc_id, r.n_removed, r.text.split("\n")[0]) for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[0] for g in got] == [1, 1, 1, 2] and got[3][1] == 1
    removed = {own: n for _, n, own in got[:3]}
    assert sorted(removed.values()) == [0, 1] and len(removed) == 2


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 5)
    monkeypatch.setattr(C, "FEW", 3)
    many = spark.createDataFrame([(k, i) for i in range(300) for k in (0, i)], "key long, x long")
    few = many.groupBy("key").agg(F.count(F.lit(1)).alias("k")).withColumn("label", F.col("key") * 2).where("key % 2 = 0")
    assert sorted(map(tuple, C.salted_join(many, few, ["key"], "k").collect())) == sorted((k, i, 2 * k) for i in range(300) for k in (0, i) if k % 2 == 0)
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {100 + i: 100 for i in range(31)}
