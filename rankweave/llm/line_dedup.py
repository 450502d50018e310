"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

Lines are trimmed of ASCII blanks; those of at least ``MIN_CHARS`` characters take part, and from
``exact_chars`` characters on, where that is given, shorter ones as far as they are equal. Two texts within
``tau`` edits (insertions, deletions, substitutions of a character) are linked, and linked texts, however
far apart along the links, are one class. The first line of a class, by (doc_id, line number), stays;
every other is removed.

The join: a line is split into tau + 1 segments of nearly equal length, and indexed by (its length, the
segment's number, the segment). A line within tau edits and no shorter holds one of these segments whole,
near its place, so each line probes the indexes of lengths from tau less than its own to its own with the
substrings at the starts that can still be within tau edits on either side. Keys are 64-bit hashes.
Candidates are verified by a bit-parallel edit distance whose machine word holds the band of 2 tau + 1
diagonals around the main one, so lines of any length take one word.

Equal lines are grouped first, by 126 bits of two hashes of the text, with partial minima before the shuffle.
The texts of lines that share a key with another, and of these alone, are then fetched once, by a filter on
their hashes, broadcast if there are at most ``FEW_IDS``, else by a join. For one edit the segments are cut
finer and finer under the keys that lines still share (``one_edit``), so lines that differ in one place only
by more than an edit never meet, and pairs are at most as many as lines and keys. For more edits, hubs join
the lines of a key, and pairs still apart after that are compared all.

Results of the corner cases: a null text stays null, with no lines; an empty text has one line, which is
empty and stays; rows of one doc_id are told apart by their text, in the order of a hash of it, and copies of
one row are treated alike, as one; columns beyond doc_id and text pass through untouched; a null doc_id comes first.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Edits allowed; characters of a line that takes part at least; candidate ids that may be broadcast (8 bytes each).
TAU, MIN_CHARS, FEW_IDS = 1, 20, 1_000_000
#: Chunks of a line that are looked for before its edit distance is taken; characters of the chunks that bound a line's links;
#: parts into which a key's free part is cut at a time.
CHUNKS, SHORT, PARTS = 12, 4, 8


def segments(length: Column, tau: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each of the tau + 1 segments: the last ones get the rest."""
    base, rest = F.floor(length / (tau + 1)), length % (tau + 1)
    out, start = [], F.lit(1)
    for i in range(tau + 1):
        size = (base + F.when(F.lit(tau + 1 - i) <= rest, 1).otherwise(0)).cast("int")
        out.append((start.cast("int"), size))
        start = start + size
    return out


def _key(text: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(i), F.substring(text, start, size))


def keys(text: Column, tau: int) -> list[Column]:
    """Index keys and probe keys of a line; a probe that cannot be is null.

    For an indexed line shorter by delta, segment i (from 0) at start p can begin in the probing line from
    max(p - i, p + delta - (tau - i)) to min(p + i, p + delta + (tau - i)): an edit before it for each
    earlier segment at most, and behind it for each later one.
    """
    n = F.length(text)
    out = [_key(text, n, i, start, size) for i, (start, size) in enumerate(segments(n, tau))]
    for delta in range(tau + 1):
        length = n - delta
        for i, (start, size) in enumerate(segments(length, tau)):
            for shift in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
                if delta == 0 and shift == 0:
                    continue  # the index key itself
                at = start + shift
                fits = (length >= tau + 1) & (at >= 1) & (at + size <= n + 1)
                out.append(F.when(fits, _key(text, length, i, at, size)))
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within(a: Column, b: Column, tau: int) -> Column:
    """True if texts of at least tau + 1 characters are within tau edits, by bit-parallel edit distance in a band.

    Bit i of a word stands for row j + i - tau of column j. Along the band's upper diagonal the distance
    grows by one where the diagonal bit is unset; from its end it follows the last row.
    """
    if not 0 <= tau <= 30:
        raise ValueError("tau from 0 to 30")
    return _let(F.struct(F.split(a, "").alias("wa"), F.split(b, "").alias("wb")), lambda w: _banded(w["wa"], w["wb"], tau))


def _banded(wa: Column, wb: Column, tau: int) -> Column:
    width = 2 * tau + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    bit = lambda c, n: F.when(c, F.lit(n).cast("long")).otherwise(F.lit(0).cast("long"))
    m = F.size(wa)

    def step(s: Column, j: Column) -> Column:
        c = F.get(wb, j - 1)
        match = F.lit(0).cast("long")
        for i in range(width):
            row = j - 1 + i - tau
            match = match.bitwiseOR(bit((row >= 0) & F.get(wa, F.greatest(row, F.lit(0))).eqNullSafe(c) & (row < m), 1 << i))
        flip = lambda x: x.bitwiseXOR(F.lit(full).cast("long"))

        def columns(x: Column) -> Column:
            d0 = (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full).cast("long"))

            def deltas(d: Column) -> Column:
                def after(h: Column) -> Column:
                    shifted = F.shiftrightunsigned(d, 1)
                    upper = j <= m - tau
                    place = F.expr("0L")
                    for back in range(1, width):  # row m in column m - tau + back
                        place = F.when(j == m - tau + back, F.lit(top >> back).cast("long")).otherwise(place)
                    along = F.when(h["hp"].bitwiseAND(place) != 0, 1).when(h["hn"].bitwiseAND(place) != 0, -1).otherwise(0)
                    grown = F.when(upper, F.when(d.bitwiseAND(F.lit(top).cast("long")) == 0, 1).otherwise(0)).otherwise(along)
                    vp = h["hn"].bitwiseOR(flip(shifted.bitwiseOR(h["hp"])))
                    return F.struct(vp.alias("vp"), shifted.bitwiseAND(h["hp"]).alias("vn"), (s["d"] + grown).cast("int").alias("d"))

                hp = s["vn"].bitwiseOR(flip(d.bitwiseOR(s["vp"])))
                return _let(F.struct(hp.alias("hp"), d.bitwiseAND(s["vp"]).alias("hn")), after)

            return _let(d0, deltas)

        return _let(match, columns)

    start = F.struct(F.lit(full ^ ((1 << tau) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(tau).alias("d"))
    near = F.abs(m - F.size(wb)) <= tau
    return F.when(near, F.aggregate(F.sequence(F.lit(1), F.size(wb)), start, step, lambda s: s["d"]) <= tau).otherwise(False)


def plausible(a: Column, b: Column, tau: int) -> Column:
    """False only for texts more than tau edits apart: tau edits touch at most tau of the first one's chunks, and
    each other chunk stands in the second one, at most tau places off."""
    size = F.greatest(F.floor(F.length(a) / CHUNKS), F.lit(1)).cast("int")
    hits = F.lit(0)
    for i in range(CHUNKS):
        start = F.lit(1) + size * i
        around = F.substring(b, F.greatest(start - tau, F.lit(1)), size + 2 * tau)
        hits = hits + F.contains(around, F.substring(a, start, size)).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= tau) & (hits >= CHUNKS - tau)


def verified(pairs: DataFrame, tau: int) -> DataFrame:
    """The rows of ``pairs(ta, tb, ...)`` whose texts are within tau edits."""
    a, b = F.col("ta"), F.col("tb")
    return pairs.where(F.when(plausible(a, b, tau), within(a, b, tau)).otherwise(False))


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_id (a hash of the row's text), line (number from 0), trimmed text and its two 64-bit hashes, of every line that takes part."""
    x = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("t", F.btrim("t", F.lit(C.BLANKS)))
    return x.where(F.length("t") >= min_chars).withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")})


def _wide(value: Column, bits: int, rest: Column) -> Column:
    return value.cast("decimal(38,0)") * F.lit(Decimal(1 << bits)).cast("decimal(19,0)") + rest


def _place() -> Column:
    """(doc_id, 30 bits of text_id, line) as one number that orders alike: of fixed width, so that hash aggregation can take its least."""
    inner = F.col("text_id").bitwiseAND(F.lit((1 << 30) - 1)) * F.lit(1 << 31) + F.col("line")
    return F.coalesce(_wide(F.col("doc_id"), 61, inner), F.lit(Decimal(-3 * 10**37)).cast("decimal(38,0)") + inner).cast("decimal(38,0)")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(id, probe, key, ...)`` whose key an indexed line and another line have."""
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("probe")).alias("indexed"))
    return C.salted_join(rows, C.stored(met.where("k > 1 AND indexed > 0").select("key", "k"), "met"), ["key"], "k", "left_semi")


def _halves(texts: DataFrame) -> DataFrame:
    """(id, probe, key, free): one row for each of the ``keys`` of one edit, with the half that the key leaves free.

    The free part of a probing row is one character longer than those of the indexed rows under its key.
    """
    n, t = F.length("t"), F.col("t")
    rows = []
    for delta in (0, 1):
        length = n - delta
        cut = F.floor(length / 2).cast("int")
        whole = ((F.lit(1), cut), (cut + 1, length - cut))
        free = (F.substring(t, cut + 1, n), F.substring(t, F.lit(1), cut + delta))
        for i, (start, size) in enumerate(whole):
            row = F.struct(F.lit(delta > 0).alias("probe"), _key(t, length, i, start + (delta if i else 0), size).alias("key"), free[i].alias("free"))
            rows.append(F.when(length >= 2, row))
    return texts.select("id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("id", "r.*")


def _finer(rows: DataFrame) -> DataFrame:
    """Each row's free part cut into ``PARTS`` or fewer: a row for each, which leaves that part free and takes the others into its key."""
    size = F.length("free") - F.col("probe").cast("int")  # of the indexed rows
    cut = lambda j: F.floor(j * F.col("size") / PARTS).cast("int")
    wider = F.col("probe").cast("int")

    def part(j: Column) -> Column:
        return F.struct(j.alias("j"), cut(j).alias("from"), (cut(j + 1) + wider).alias("to"))

    cuts = rows.withColumn("size", size).withColumn("p", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), part), lambda p: p["to"] - p["from"] > wider)))
    before, after = F.substring(F.col("free"), F.lit(1), F.col("p.from")), F.substring(F.col("free"), F.col("p.to") + 1, F.length("free"))
    key = F.when(F.col("size") > 1, F.xxhash64("key", "p.j", before, after)).otherwise(F.col("key"))
    return cuts.select("id", "probe", key.alias("key"), F.substring(F.col("free"), F.col("p.from") + 1, F.col("p.to") - F.col("p.from")).alias("free"))


def one_edit(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``texts(id, t)`` that connect all lines within one edit of each other, as many as lines and keys at most.

    Lines that share a key agree in all but its free part. That part is cut again and again, and only keys
    that lines still share go on, until it is one character. The indexed lines under a key then differ in
    that one character, so each is paired with the least of them alone; a line longer by one has two
    characters there, and is paired with the indexed line that has either of them, of which there is one.
    """
    rows = C.stored(_shared(_halves(texts)), "halves")
    longest = lambda: rows.agg(F.max(F.length("free") - F.col("probe").cast("int"))).first()[0] or 0
    while longest() > 1:
        rows = C.stored(_shared(_finer(rows)), "parts")
    indexed, probes = rows.where("NOT probe"), rows.where("probe")
    least = indexed.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "a")
    changed = indexed.join(least, "key").where("a <> id").select("a", F.col("id").alias("b"))
    either = F.array_distinct(F.array(F.substring("free", 1, 1), F.substring("free", 2, 1)))
    longer = probes.select(F.col("id").alias("b"), "key", F.explode(either).alias("free")).join(indexed.select(F.col("id").alias("a"), "key", "free"), ["key", "free"])
    return changed.unionByName(longer.select("a", "b")).distinct()


def linkable(texts: DataFrame, tau: int) -> DataFrame:
    """id, size, most and own (see ``hub_links``) of those of ``texts(id, t)`` that may be within tau edits of another of them.

    tau edits touch at most tau of a line's short chunks; each other chunk stands in the other line at most
    tau places off. A line more of whose chunks no other line has near their place is alone.
    """
    chunk = lambda at: F.substring("t", at + 1, F.lit(SHORT))
    starts = lambda n: texts.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / SHORT).cast("int") - 1, F.lit(0))), lambda i: i * SHORT)))
    own = starts(F.length("t")).select("id", F.xxhash64("at", chunk(F.col("at"))).alias("c"))
    places = F.array_distinct(F.array(*(F.greatest(F.col("at") + d, F.lit(0)) for d in range(-tau, tau + 1))))
    # a line meets chunks of lines up to tau longer
    near = starts(F.length("t") + tau).withColumn("from", F.explode(places)).select("id", F.xxhash64("at", chunk(F.col("from"))).alias("c"))
    held = near.groupBy("c").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    hits = own.join(held, "c").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id"))).alias("hits"))
    own = hits.where(F.col("hits") >= F.col("n") - tau).select("id", (F.col("n") - F.col("hits")).alias("own"))
    return texts.join(own, "id").select("id", F.length("t").cast("long").alias("size"), (F.length("t") + tau).cast("long").alias("most"), "own")


def _linked(texts: DataFrame, tau: int) -> DataFrame:
    """(id, cls) of every one of ``texts(id, t)`` that is linked with another; cls is the least id reachable."""

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
        spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are few bytes and much work
        return verified(both.repartition(spread, "a", "b"), tau).select("a", "b")

    if tau == 1:
        return C.components(C.stored(similar(one_edit(texts)), "similar")).toDF("id", "cls")
    keyed = texts.select("id", F.explode(F.array_distinct(F.array(*keys(F.col("t"), tau)))).alias("key")).where("key IS NOT NULL")
    return C.hub_links(keyed, similar, lambda ids: linkable(texts.join(ids, "id", "left_semi"), tau)).toDF("id", "cls")


def classes(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """h1, h2, n, first and cls of every line that has a copy or a link: its number, first place, and its class (the least id linked)."""
    least = min_chars if exact_chars is None else exact_chars
    tau_keys = [F.when(F.length("t") >= min_chars, k) for k in keys(F.col("t"), tau)] if tau else []
    x = lines(docs, least).select("h1", "h2", _place().alias("place"), *(k.alias(f"k{i}") for i, k in enumerate(tau_keys)))
    names = [f"k{i}" for i in range(len(tau_keys))]
    distinct = C.stored(x.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *(F.max(k).alias(k) for k in names)), "lines")
    book = distinct.select("h1", "h2", "first", "n", C.wide_id(F.col("h1"), F.col("h2")).alias("id"))
    if not names:
        return book.where("n > 1").withColumn("cls", F.col("id")).drop("id")
    # the first tau + 1 keys are those of the index
    keyed = distinct.select("h1", "h2", "first", F.posexplode(F.array(*names)).alias("i", "key")).where("key IS NOT NULL").withColumn("probe", F.col("i") > tau)
    meet = C.stored(_shared(keyed).select("h1", "h2", "first").distinct(), "meet")
    few = meet.limit(FEW_IDS + 1).count() <= FEW_IDS
    there = lines(docs, min_chars).withColumn("place", _place()).join(F.broadcast(meet) if few else meet, ["h1", "h2"]).where("place = first")
    found = C.stored(_linked(C.stored(there.select(C.wide_id(F.col("h1"), F.col("h2")).alias("id"), "t").dropDuplicates(["id"]), "texts"), tau), "linked")
    linked = book.join(found, "id").drop("id")
    return linked.unionByName(book.where("n > 1").join(found, "id", "left_anti").withColumn("cls", F.col("id")).drop("id"))


def dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """``docs`` with the removed lines gone from ``text``, and n_lines and n_removed."""
    book = C.stored(classes(docs, tau, min_chars, exact_chars), "classes")
    stays = book.groupBy("cls").agg(F.min("first").alias("stays"))
    known = C.stored(book.join(stays, "cls").select("h1", "h2", "n", "stays"), "known")
    occurrences = lines(docs, min_chars if exact_chars is None else exact_chars).select("doc_id", "text_id", "line", "h1", "h2")
    gone = C.salted_join(occurrences, known, ["h1", "h2"], "n").where(_place() != F.col("stays")).groupBy("doc_id", "text_id").agg(F.collect_set("line").alias("gone"))
    gone = gone.toDF("gone_of", "gone_from", "gone")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_of")) & (F.xxhash64("text") == F.col("gone_from")), "left").drop("gone_of", "gone_from")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(F.col("gone"), i))
    return out.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"), "n_removed": F.when(F.col("gone").isNull() | F.col("text").isNull(), 0).otherwise(F.size(F.col("gone"))).cast("long"), "text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))}).drop("gone")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: For one edit: of two lines of 20 characters or more, the first ten or the last ten are then the same.
ORACLE = f"""
WITH RECURSIVE q AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
o AS (SELECT doc_id, line, t FROM (SELECT doc_id, unnest(range(0, len(l))) AS line, trim(unnest(l), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM q) WHERE length(t) >= {MIN_CHARS}),
d AS (SELECT t, row_number() OVER (ORDER BY t) AS id, count(*) AS n FROM o GROUP BY t),
l AS (SELECT x.id AS x, y.id AS y FROM d x JOIN d y ON left(x.t, 10) = left(y.t, 10) AND x.id < y.id AND abs(length(x.t) - length(y.t)) <= 1 AND levenshtein(x.t, y.t) <= 1
      UNION SELECT x.id, y.id FROM d x JOIN d y ON right(x.t, 10) = right(y.t, 10) AND x.id < y.id AND abs(length(x.t) - length(y.t)) <= 1 AND levenshtein(x.t, y.t) <= 1),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS x, x AS c FROM l UNION SELECT y, y FROM l UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x WHERE r.c < e.y),
m AS (SELECT d.t, coalesce(c.c, d.id) AS cls FROM d LEFT JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) c ON c.x = d.id),
g AS (SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY cls ORDER BY doc_id, line) AS k FROM o JOIN m ON m.t = o.t) WHERE k > 1),
k AS (SELECT doc_id, list(line) AS gone FROM g GROUP BY doc_id),
f AS (SELECT q.doc_id, text, l, gone, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS kept FROM q LEFT JOIN k ON k.doc_id = q.doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM f
"""
