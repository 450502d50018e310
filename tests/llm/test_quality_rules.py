import random
import re

from rankweave.llm import quality_rules as Q

WS = "[\\x20\\x09-\\x0D]+"


def brute(text):
    text = text or ""
    w = [x for x in re.split(WS, text) if x]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + o for at in windows.values() if len(at) > 1 for i in at for o in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a b", "a b c", "a b c a b c", "x x x x", "é ü # | \n\n  \nq\nq", "\x1ca b", "one two three " * 50]
    texts += ["".join(rng.choice(["a", "b", "cc", " ", "  ", "\n", "\t", "#", "\x0b", "Ä"]) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts.append("long word " * 30_000)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b c", 2)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in Q.ledger(df).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        few = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert few == bool(r.fail_bits & Q.BASE)
    assert Q.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    rng = random.Random(4)
    bits = [rng.randrange(1 << len(Q.RULES)) if rng.random() < 0.5 else 0 for _ in range(500)]
    book = spark.createDataFrame(list(enumerate(bits)), "doc_id long, fail_bits long")
    for version, mask in Q.POLICIES.items():
        rows = Q.apply_policy(book, version).collect()
        assert all(r.kept == (r.fail_bits & mask == 0) for r in rows)
        assert all(set(r.reasons) == {n for n, b in Q.BIT.items() if b & mask & r.fail_bits} for r in rows)
    for r in Q.ablations(book).collect():
        mask, bit = Q.POLICIES[r.version], Q.BIT[r.rule]
        assert r.fails == sum(bool(b & bit) for b in bits)
        assert r.only_this == sum(b & mask == bit for b in bits)
        assert r.kept == sum(b & mask == 0 for b in bits)
        assert r.kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = Q.apply_policy(Q.evaluated(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_filter_measures_no_text(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(5000))
    df = spark.createDataFrame([(1, text, 4), (2, "few words", 5)], "doc_id long, text string, fail_bits int")
    kept = Q.apply_policy(Q.ledger(df)).where("kept AND n_repeat_words * 2 < n_words")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "sort_array" not in plan
    assert [(r.doc_id, r.n_words, r.text == text) for r in kept.collect()] == [(1, 5000, True)]
