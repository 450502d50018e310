import random

import public_tokenizers as P

import corpus_pipeline as CP
from rankweave.llm import bpe, mixing


def documents(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, "\n".join(line(rng.randrange(20, 40)) for _ in range(4)), "en", f"s{i % 3}") for i in range(60)]
    body = rows[5][1].split()
    body[7] = "changed"
    rows += [(100, rows[5][1], "en", "s0"), (101, " ".join(body), "en", None), (102, "short", "en", "s1"), (103, "again and again " * 60, "en", "s1"), (104, None, None, "s1"), (105, rows[9][1].split("\n")[0] + "\n" + line(80), "en", "s2")]
    return spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in CP.STAGES] == ["quality_rules", "line_dedup", "minhash", "mixing", "byte_bpe"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    kept = CP.quality(spark, docs, "").cache()
    assert ids(kept) == [*range(60), 100, 101, 105] and kept.columns == CP.COLUMNS
    lined = CP.lines(spark, kept, "").cache()
    assert ids(lined) == [*range(60), 101, 105] and lined.columns == CP.COLUMNS
    texts = {r.doc_id: r for r in lined.collect()}
    assert texts[105].text.count("\n") == 0 and texts[105].n_chars == len(texts[105].text)
    near = CP.near_duplicates(spark, lined, "").cache()
    assert ids(near) == [*range(60), 105] and near.columns == CP.COLUMNS
    mixed = CP.mix(spark, near, "").cache()
    assert mixed.columns == CP.COLUMNS and set(ids(mixed)) <= set(ids(near)) and max(map(ids(mixed).count, ids(mixed))) <= 2
    out = CP.tokens(spark, mixed, "").collect()
    own = bpe.ByteBpe.parse(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    assert len(out) == mixed.count() and all(own.decode(bytes(r.ids)).decode() == texts[r.doc_id].text and len(r.ids) == 4 * r.n_tokens for r in out)
    assert sorted((r.doc_id, r.n_tokens) for r in CP.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.n_tokens) for r in out)


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    for _, stage in CP.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_mix_meets_targets(spark):
    rows = [(i, "some words of a text " * (i % 40 + 1), f"s{i % 4}") for i in range(200)] + [(900, "long\n" * 30_000, "one long"), (None, "no id " * 50, "nulls"), (None, "none " * 120, "nulls")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
    want, came = {}, {}
    for r in mixing.taken(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    for r in CP.mix(spark, docs, "").collect():
        came[r.source] = came.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert {s for s, n in want.items() if abs(came.get(s, 0) - n) > mixing.BLOCK} == set()


def test_lines_drops_short_repeats(spark):
    rows = [(1, "Menu\n\nown line one\n\nMenu"), (2, " Menu\nMenus\nanother own line"), (3, "Menu")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in CP.lines(spark, docs, "").collect()} == {1: "Menu\n\nown line one\n", 2: "Menus\nanother own line"}


def test_repeated_and_null_ids(spark):
    rng = random.Random(31)
    text = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(90))
    one, other, third, null = text(), text(), text(), text()
    rows = [(1, one), (2, one), (2, other), (3, third), (3, third), (None, null), (None, null), (None, third), (4, None), (4, None), (5, "long " * 40_000), (6, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    near = [(r.doc_id, r.text) for r in CP.near_duplicates(spark, docs, "").collect()]
    thirds = [x for x in near if x[1] == third]
    assert len(thirds) == 1 and len(near) == 6
    assert sorted((i or 0, t or "") for i, t in near if t != third) == sorted([(1, one), (2, other), (0, null), (4, ""), (5, "long " * 40_000)])
    kept = CP.quality(spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 0, 1, 2, 2, 3, 3] and kept[0].asDict().keys() == set(CP.COLUMNS)
    lined = CP.lines(spark, CP.quality(spark, docs, ""), "").collect()
    assert sorted({r.text for r in lined}) == sorted([one, other, third, null])
    mixed = CP.mix(spark, CP.near_duplicates(spark, CP.quality(spark, docs, ""), ""), "").collect()
    assert {r.text for r in mixed} <= {one, other, third, null} and any(r.doc_id is None for r in mixed)
    assert CP.tokens(spark, docs, "").count() == len(rows)
