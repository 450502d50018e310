"""MinHash near-duplicates with tensored banding.

A document is its set of distinct word shingles. Two small collections of ``SIDE`` bands, each of ``ROWS``
minhashes, give SIDE * SIDE table keys, one for every pair of a band of the first and one of the second:
as many tables of 2 * ROWS minhashes as would else take ROWS * SIDE * SIDE * 2 of them. At a similarity
of 0.8, two documents share no key with a probability of 2 * (1 - 0.8 ** ROWS) ** SIDE.

Documents of one set are one class. A band's value that one class alone has makes no key, so most classes
have none. In each table, classes under a key are compared with a hub, the class of the key that has most
keys, and a pair counts if the similarity of the full sets reaches the threshold. Classes that are not joined
with their hub then meet the other members in further rounds: first the one with the fewest shingles that no
other has, which is nearest to what the copies of a text have in common, then any. A class none of whose
candidates has a size that its own shingles leave possible goes before that. What is still apart after
``HUB_ROUNDS`` rounds meets by what it differs in from its hub (``by_differences``): copies with edits of
their own differ from each other in both their edits, so only such as share edits can be linked. So a large
group of near copies never makes all its pairs, and no link between components is lost.

Results of the corner cases: a null text, an empty one or one of blanks has no shingle, no link, and is
its own component; fewer words than a shingle takes are one shingle; repeated rows are nodes of their own
under one doc_id and give a row each; a null doc_id has no links and a null component; columns beyond
doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Bands on either side, minhashes in a band, rounds of hubs.
SIDE, ROWS, HUB_ROUNDS = 12, 3, 2
#: Bits of a set's bitmap.
BITS = 1024
SEED = 41
#: Words a worker remembers the hashes of.
CACHE_WORDS = 300_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, from its words' hashes in order."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    x = np.full(n - width + 1, np.uint64(width if n < size else 0))  # a short text is no shingle of a longer one
    for k in range(width):
        x = _mix(x * np.uint64(3) + words[k : n - width + 1 + k])
    return np.unique(x)


class MinHasher:
    """The bands of a set, by multiply-shift hashes of its shingles."""

    def __init__(self, side: int = SIDE, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.side, self.rows = side, rows
        self.a = rng.integers(0, 2**63, 2 * side * rows, dtype="uint64") * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, 2 * side * rows, dtype="uint64")

    def bands(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the bands of either collection."""
        low = np.full(len(self.a), np.iinfo("uint64").max, dtype="uint64")
        for i in range(0, len(x), 2048):
            part = x[i : i + 2048]
            h = part[None, :] * self.a[:, None] + self.b[:, None]
            h ^= h >> np.uint64(32)
            h *= np.uint64(_MIX[0])
            np.minimum(low, h.min(axis=1), out=low)
        low = _mix(low + np.arange(len(low), dtype="uint64")).reshape(2, self.side, self.rows)
        out = np.zeros((2, self.side), dtype="uint64")
        for k in range(self.rows):
            out = _mix(out * np.uint64(3) + low[:, :, k])
        return out[0], out[1]


class _Sets:
    """Shingle sets of texts; remembers words' hashes."""

    def __init__(self, size: int):
        self.size, self.get = size, _Words().__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_LOWER).split()
        return shingles(np.fromiter(map(self.get, words), "uint64", len(words)), self.size)


def _cls(grams: np.ndarray) -> tuple[int | None, int | None]:
    """The two halves of a set's 128-bit hash."""
    if not len(grams):
        return None, None
    h = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _bits(grams: np.ndarray) -> np.ndarray:
    """A bitmap of the set: bit i is set if a shingle's hash ends in i."""
    on = np.zeros(BITS, dtype=bool)
    on[(grams & np.uint64(BITS - 1)).astype("int64")] = True
    return np.packbits(on).view("int64")


def _signed(docs: DataFrame, size: int, hasher: MinHasher, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, the columns ``keep``, n_shingles, cls (126 bits of the set's hash), the bands of either collection and the set's bitmap, in one pass over the texts."""

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sets = _Sets(size)
        for batch in batches:
            counts, cls, a, b, bits = [], [], [], [], []
            for text in batch:
                x = sets(text)
                low = hasher.bands(x) if len(x) else (None, None)
                counts.append(len(x))
                cls.append(_cls(x))
                a.append(None if low[0] is None else low[0].view("int64"))
                b.append(None if low[1] is None else low[1].view("int64"))
                bits.append(_bits(x) if len(x) else None)
            c1, c2 = (pd.array([c[i] for c in cls], dtype="Int64") for i in (0, 1))
            yield pd.DataFrame({"n_shingles": counts, "c1": c1, "c2": c2, "a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object), "bits": pd.Series(bits, dtype=object)})

    found.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    signs = F.pandas_udf(found, "n_shingles long, c1 long, c2 long, a array<long>, b array<long>, bits array<long>")(F.col("text").cast("string"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, signs.alias("s")).select("doc_id", *keep, "s.*")
    return out.select("doc_id", *keep, "n_shingles", C.wide_id(F.col("c1"), F.col("c2")).alias("cls"), "a", "b", "bits")


def _grams(docs: DataFrame, size: int) -> DataFrame:
    """(cls, h) of every row: the sorted shingle hashes."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = _Sets(size)
        for f in frames:
            for at in range(0, len(f), 1000):
                own = [x for x in map(sets, f.text.iloc[at : at + 1000]) if len(x)]
                cls = [_cls(x) for x in own]
                yield pd.DataFrame({"c1": pd.array([c[0] for c in cls], dtype="int64"), "c2": pd.array([c[1] for c in cls], dtype="int64"), "h": pd.Series([x.view("int64") for x in own], dtype=object)})

    out = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(found, "c1 long, c2 long, h array<long>")
    return out.select(C.wide_id(F.col("c1"), F.col("c2")).alias("cls"), "h")


def tensor_keys(classes: DataFrame) -> DataFrame:
    """(key, id): the table keys of ``classes(cls, a, b)``, one for each pair of a band of ``a`` and one of ``b``, but for those of bands that no other class has."""

    def side(name: str) -> Column:
        return F.transform(name, lambda x, i: F.struct(F.lit(name == "a").alias("first"), F.xxhash64(x, i, F.lit(name)).alias("band")))

    rows = classes.select("cls", F.explode(F.concat(side("a"), side("b"))).alias("x")).select("cls", "x.*")
    shared = C.stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "bands")
    some = lambda first: F.collect_list(F.when(F.col("first") == first, F.col("band")))
    both = C.salted_join(rows, shared, ["band"], "k", "left_semi").groupBy("cls").agg(some(True).alias("a"), some(False).alias("b"))
    keys = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    return C.stored(both, "both").select(F.explode(keys).alias("key"), F.col("cls").alias("id"))


class _Full:
    """The full sets of classes, made again from one text each and stored, as far as they are asked for."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int):
        self.docs, self.classes, self.size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), classes, size
        self.held: DataFrame | None = None

    def __call__(self, cls: DataFrame) -> DataFrame:
        """A frame (cls, h) that has all of ``cls(cls)``, and maybe others."""
        if self.held is not None:
            cls = cls.join(self.held, "cls", "left_anti")
        ids = C.stored(cls.join(self.classes.select("cls", "first"), "cls").select("cls", F.col("first").alias("doc_id")).distinct(), "ids")
        ids = C.if_few(ids)
        texts = self.docs.join(ids, "doc_id", "left_semi")
        new = C.stored(_grams(texts, self.size).join(ids, "cls", "left_semi"), "grams")
        if new.count() > ids.count():  # rows of one doc_id
            new = C.stored(new.dropDuplicates(["cls"]), "grams")
        self.held = new if self.held is None else self.held.unionByName(new)
        return self.held


def linkable(ids: DataFrame, full: _Full, percent: int) -> DataFrame:
    """id, size, most and own (see ``hub_links``) of those of ``ids(id)`` that may be similar to another of them.

    Of a set of n shingles, u of which no other of these sets has, the intersection with any of them has at
    most n - u, so a partner has at most (100 + percent) * (n - u) / percent - n shingles, and n - u at least.
    A text with many edits of its own is ruled out without meeting its near copies.
    """
    cls = C.if_few(ids.select(F.col("id").alias("cls")))
    grams = full(cls).join(cls, "cls", "left_semi")
    own = grams.select("cls", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("cls").alias("cls")).where("k = 1").groupBy("cls").agg(F.count(F.lit(1)).alias("u"))
    sizes = grams.select("cls", F.size("h").cast("long").alias("size"))
    out = sizes.join(own, "cls", "left").select(F.col("cls").alias("id"), "size", F.coalesce("u", F.lit(0)).alias("own"))
    most = F.floor((100 + percent) * (F.col("size") - F.col("own")) / percent).cast("long") - F.col("size")
    return out.withColumn("most", most).where(F.col("most") >= F.col("size") - F.col("own"))


def by_differences(now: DataFrame, full: _Full, percent: int) -> DataFrame:
    """Pairs (a, b) of ``now(key, id, label, size, own, ...)``, more than one label under each key: enough to join all that are linked and differ in label.

    Keys that share ids, at first hand or by other keys, have one hub (``spheres``), so an id is described once, however
    many keys it has: by D, the shingles that it or its hub alone has. Members linked with their hub are pairs with
    it. The union of two sets x and y is larger than their intersection by |Dx| + |Dy| - 2 |Dx and Dy|, which for a
    link is at most (100 - percent) / (100 + percent) of |x| + |y|. If both are linked with the hub, it joins them. Else
    one of the two is not, nor has the hub's label, if the hub doesn't join them so, and its D is larger than that;
    hence a link needs common members of Dx and Dy, under two labels, for
    each set at least as many as the least possible D of a partner demands. So the two share one of the first
    |D| - that number + 1 of each D, by rising frequency under the hub; members that one label alone has come first.
    Those that do are compared on all members of D that other labels have, by half of each hash: a few pairs more may
    pass, as ``verified`` looks at full sets, and none is lost. Whole D are sent only to members that meet (``meeting``).
    """
    up, down = 100 + percent, 100 - percent
    members = spheres(now)
    members = C.if_few(C.stored(members, "members"))
    sets = full(members.select(F.col("id").alias("cls")).unionByName(members.select(F.col("hub").alias("cls"))).distinct())
    counts = C.if_few(C.stored(members.groupBy("hub").agg(F.count(F.lit(1)).alias("k")), "counts"))
    few = C.stored(sets.toDF("hub", "hh").join(counts, "hub"), "hubs")
    both = C.salted_join(sets.toDF("id", "h").join(members, "id"), few, ["hub"], "k", wide=True)
    d = F.concat(F.array_except("h", "hh"), F.array_except("hh", "h"))
    x = both.select("hub", "id", "other", "label", F.size("h").cast("long").alias("n"), F.size("hh").alias("nh"), d.alias("d"))
    near = up * F.size("d") <= down * (F.col("n") + F.col("nh"))
    x = C.stored(x.select("hub", "id", (F.col("other") & near).alias("near"), (F.col("other") & ~near).alias("other"), "label", "n", "d"), "differences")
    linked = x.where("near").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    rows = x.select("hub", "id", "label", F.explode("d").alias("e"))
    often = rows.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    often = C.stored(often.select("hub", "e", "f", F.col("f").alias("k")), "often")
    shared = C.salted_join(rows.drop("label"), often, ["hub", "e"], "k").groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("shared"))
    x = x.join(shared, ["hub", "id"]).select("hub", "id", "other", "label", "n", F.size("d").cast("long").alias("d"), "shared").withColumn("over", up * F.col("d") - down * F.col("n"))
    x = C.stored(x, "shared")
    least = x.groupBy("hub").agg(F.min("over").alias("any"), F.min(F.when(F.col("other"), F.col("over"))).alias("apart"), F.count(F.lit(1)).alias("k")).where("apart IS NOT NULL")
    x = C.salted_join(x, C.stored(least, "least"), ["hub"], "k")

    def first(partner: str) -> Column:
        common = F.greatest(F.ceil((F.col("over") + F.col(partner)) / F.lit(2 * up)).cast("long"), F.lit(1))
        own = F.col("d") - F.size("shared")
        return F.greatest(F.col("d") - common + 1 - own, F.lit(0)).cast("int")

    # half of each hash tells members apart but for a few, which ``lost`` counts
    half = F.array_distinct(F.transform("shared", lambda v: F.shiftright(v["e"], 32).cast("int")))
    x = x.select("hub", "id", "label", "over", F.size("shared").alias("n"), half.alias("s"), F.col("shared.e").alias("e"), F.when(F.col("other"), first("any")).otherwise(0).alias("na"), first("apart").alias("nb"))
    x = C.stored(x.withColumn("lost", F.col("n") - F.size("s")), "sides")
    met = meeting(x)
    side = lambda e: x.join(met, ["hub", "id"]).select("hub", "id", "label", "over", "n", "lost", "s", F.explode(e).alias("e"))
    b = side("b").drop("lost").toDF("hub", "b", "lb", "overb", "m", "sb", "e")
    enough = f"over + overb <= {2 * up} * least(n, m) AND over + overb <= {2 * up} * (size(array_intersect(s, sb)) + lost)"
    found = side("a").join(b, ["hub", "e"]).where(f"id <> b AND label <> lb AND {enough}")
    return linked.unionByName(found.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())


def spheres(now: DataFrame) -> DataFrame:
    """(hub, id, other, label) of ``now(key, id, label, own, ...)``: each id but the hubs once, and if its label is another than its hub's.

    Keys that ids join, however many, have one hub: of their ids, the one with the fewest shingles of its own.
    """
    firsts = C.stored(now.groupBy("key").agg(F.min(F.struct("own", "id")).alias("first"), F.count(F.lit(1)).alias("k")), "firsts")
    links = C.salted_join(now, firsts, ["key"], "k").select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    parts = C.stored(C.components(links), "spheres").toDF("id", "sphere")
    ids = C.stored(now.select("id", "label", "own").distinct().join(parts, "id"), "ids")
    hubs = C.stored(ids.groupBy("sphere").agg(F.min(F.struct("own", "id", "label")).alias("hub"), F.count(F.lit(1)).alias("k")), "hubs")
    return C.salted_join(ids, hubs, ["sphere"], "k").where("id <> hub.id").select(F.col("hub.id").alias("hub"), "id", (F.col("label") != F.col("hub.label")).alias("other"), "label")


def meeting(x: DataFrame) -> DataFrame:
    """(hub, id, a, b) of ``x(hub, id, label, e, na, nb)``: of the first ``na`` members of e, and of the first ``nb``, those that are under two labels among the others' first ones.

    Members alone, a few numbers a row, tell which rows meet any, before rows with whole sets are sent.
    """
    rows = x.select("hub", "id", "label", "na", "nb", F.posexplode(F.slice("e", F.lit(1), F.greatest("na", "nb"))).alias("i", "e"))
    rows = rows.select("hub", "id", "label", "e", (F.col("i") < F.col("na")).alias("a"), (F.col("i") < F.col("nb")).alias("b"))
    several = rows.groupBy("hub", "e").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("k")).where("low < high AND a AND b")
    some = lambda side: F.collect_list(F.when(F.col(side), F.col("e"))).alias(side)
    return C.stored(C.salted_join(rows, C.stored(several.select("hub", "e", "k"), "several"), ["hub", "e"], "k").groupBy("hub", "id").agg(some("a"), some("b")), "meeting")


def verified(pairs: DataFrame, classes: DataFrame, full: _Full, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` of classes with 100 * intersection >= percent * union, on the full sets; few classes are an a.

    Sizes and bitmaps rule out pairs first: each bit that one set's bitmap alone has is a shingle at least that
    the other set lacks. Sets are then brought to where their pair's a is, each a's own once.
    """
    pairs = C.if_few(pairs)
    ids = C.if_few(C.stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ids"))
    known = C.stored(classes.select("cls", "n_shingles", "bits").join(ids, "cls", "left_semi"), "known")
    missing = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda t, n: t + n)
    common = F.least(F.col("na") - missing("ba", "bb"), F.col("nb") - missing("bb", "ba"))
    close = known.toDF("a", "na", "ba").join(pairs, "a").join(known.toDF("b", "nb", "bb"), "b").where((100 + percent) * common >= percent * (F.col("na") + F.col("nb"))).select("a", "b")
    close = C.if_few(C.stored(close, "close"))
    grams = full(close.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    theirs = grams.toDF("b", "hb").join(close, "b")
    counts = C.if_few(C.stored(close.groupBy(F.col("a").alias("cls")).agg(F.count(F.lit(1)).alias("k")), "counts"))
    hubs = C.stored(grams.join(counts, "cls").select(F.col("cls").alias("a"), F.col("h").alias("ha"), "k"), "hubs")
    both = F.size(F.array_intersect("ha", "hb"))
    similar = 100 * both >= percent * (F.size("ha") + F.size("hb") - both)
    return C.salted_join(theirs, hubs, ["a"], "k", wide=True).where(similar).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, side: int = SIDE, rows: int = ROWS, hub_rounds: int = HUB_ROUNDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, n_shingles, component_id (the least doc_id reachable) and kept for every row of ``docs(doc_id, text)`` and its columns ``keep``."""
    signed = C.stored(_signed(docs, shingle, MinHasher(side, rows), keep), "signed")
    classes = C.stored(signed.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("bits").alias("bits")), "classes")
    full = _Full(docs, classes, shingle)
    found = C.hub_links(tensor_keys(classes), lambda pairs: verified(pairs, classes, full, percent), lambda ids: linkable(ids, full, percent), hub_rounds, lambda now: by_differences(now, full, percent)).toDF("cls", "label")
    labelled = classes.select("cls", "first", "last", "n_docs").join(found, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "label").where("first <> last OR first <> component_id").select("cls", "n_docs", F.col("component_id").alias("c"))
    out = C.salted_join(signed.select("doc_id", *keep, "n_shingles", "cls"), C.stored(named, "named"), ["cls"], "n_docs", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", *keep, "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), shingle=2, percent=80)


ORACLE = """
WITH RECURSIVE a AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM a),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM j JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS c FROM a UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x WHERE r.c < e.y)
SELECT a.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, a.doc_id = m.c AS kept FROM a LEFT JOIN n ON n.doc_id = a.doc_id JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = a.doc_id
"""
