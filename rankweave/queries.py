"""The engine's queries over the driver's tables, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ranks as R
from .operators import bounds as B
from .operators import digest as D
from .operators import joins as J
from .operators import stats as T
from .operators import windows as X
from .operators.scratch import scratch_path
from .plans import grid as G
from .plans import mining as M
from .sources import series as S
from .sources import text_source as N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return S.from_table(_t(spark, d, "orders"), F.col("o_orderpriority"), ["o_orderkey"], F.col("o_totalprice"), sizes=True)


def events(spark: SparkSession, d: str) -> DataFrame:
    return S.from_table(_t(spark, d, "events"), F.col("user_id"), ["ts", "event_id"], F.col("value"), sizes=True)


def event_types(spark: SparkSession, d: str) -> DataFrame:
    return S.from_table(_t(spark, d, "events"), F.col("event_type"), ["ts", "event_id"], F.col("value"), sizes=True)


def quantities(spark: SparkSession, d: str) -> DataFrame:
    return S.from_table(_t(spark, d, "lineitem"), F.concat_ws("-", "l_returnflag", "l_linestatus"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity"), sizes=True)


def run_log(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("event_type").alias("dataset"), (F.col("user_id") % 5).cast("string").alias("mode"), F.col("value").alias("runtime_ms"), "event_id")


_FROM = {
    orders: ("o_orderpriority", "o_orderkey", "o_totalprice", "orders"),
    events: ("user_id::VARCHAR", "ts, event_id", "value", "events"),
    event_types: ("event_type", "ts, event_id", "value", "events"),
    quantities: ("l_returnflag || '-' || l_linestatus", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice", "l_quantity", "lineitem"),
}
_LOG = "WITH r AS (SELECT event_type AS dataset, (user_id % 5)::VARCHAR AS mode, value AS runtime_ms, event_id FROM events)"
_TEXT = "'(' || array_to_string({0}, ',') || ')'"


def _shape(x: str) -> str:
    return f"list_transform({x}, lambda v: len(list_filter({x}, lambda u: u <= v)))"


def _without(x: str, at: str) -> str:
    return f"list_transform(list_filter({x}, lambda v: v <> {x}[{at}]), lambda v: v - (CASE WHEN v > {x}[{at}] THEN 1 ELSE 0 END))"


def _series(src: Query) -> str:
    key, order, value, table = _FROM[src]
    return f"""s AS (SELECT {key} AS series_id, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS pos,
      count(*) OVER (PARTITION BY {key}) AS n, {value}::DOUBLE AS value FROM {table})"""


def _windows(src: Query, lo: int, hi: int) -> str:
    """CTEs s, w (windows) and o (occurrences with ranks, text and weight)."""
    return f"""WITH {_series(src)},
    b AS (SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {hi - 1} PRECEDING AND CURRENT ROW) AS buf FROM s),
    e AS (SELECT *, unnest(range({lo}, least({hi}, len(buf)) + 1)) AS m FROM b),
    w AS (SELECT series_id, pos, n, m, list_slice(buf, len(buf) - m + 1, len(buf)) AS win FROM e),
    o AS (SELECT series_id, pos, n, m, {_shape('win')} AS ranks, exp(-(1.0 / n) * ((n - 1) - pos)) AS wt FROM w WHERE len(list_distinct(win)) = m)"""


def _patterns(src: Query, lo: int, hi: int) -> str:
    return _windows(src, lo, hi) + """,
    p AS (SELECT series_id, n, m, ranks, count(*) AS n_occ, sum(wt ORDER BY pos) AS support FROM o GROUP BY series_id, n, m, ranks)"""


def _top(src: Query, lo: int, hi: int, k: int) -> str:
    return _patterns(src, lo, hi) + f""",
    t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY support DESC, m, ranks) AS rank FROM p QUALIFY rank <= {k})"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


_P = _TEXT.format("ranks")


@query("windows", _windows(orders, 4, 4) + " SELECT series_id, pos, array_to_string(list_transform(win, lambda v: round(v * 100)::BIGINT), ' ') AS win FROM w")
def windows(spark, d):
    cents = F.transform("win", lambda v: F.round(v * 100).cast("long").cast("string"))
    return X.windows(orders(spark, d), 4, 4).select("series_id", F.col("pos").cast("long").alias("pos"), F.array_join(cents, " ").alias("win"))


@query("tie_reject", _windows(quantities, 3, 3) + " SELECT series_id, count(*) FILTER (len(list_distinct(win)) = m) AS kept, count(*) FILTER (len(list_distinct(win)) < m) AS dropped FROM w GROUP BY series_id")
def tie_reject(spark, d):
    free = R.tie_free(F.col("win"))
    return X.windows(quantities(spark, d), 3, 3).groupBy("series_id").agg(F.count_if(free).alias("kept"), F.count_if(~free).alias("dropped"))


@query("len_range", _patterns(events, 2, 5) + " SELECT m::BIGINT AS m, count(*) AS patterns, sum(n_occ)::BIGINT AS occurrences FROM p GROUP BY m")
def len_range(spark, d):
    found = X.pattern_counts(X.occurrences(events(spark, d), 2, 5))
    return found.groupBy(F.col("m").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("patterns"), F.sum("n_occ").alias("occurrences"))


@query("rank_encode", _windows(orders, 4, 4) + f" SELECT series_id, pos, {_P} AS pattern FROM o")
def rank_encode(spark, d):
    return X.occurrences(orders(spark, d), 4, 4).select("series_id", F.col("pos").cast("long").alias("pos"), R.compact(F.col("ranks")).alias("pattern"))


def _distinct(spark, d, m):
    return X.occurrences(orders(spark, d), m, m).select("ranks").distinct()


_DISTINCT4 = _windows(orders, 4, 4) + ", q AS (SELECT DISTINCT ranks FROM o)"


@query("prefix_key", _DISTINCT4 + f" SELECT {_P} AS pattern, {_TEXT.format(_without('ranks', '4'))} AS key FROM q")
def prefix_key(spark, d):
    return _distinct(spark, d, 4).select(R.compact(F.col("ranks")).alias("pattern"), R.compact(R.prefix_key(F.col("ranks"))).alias("key"))


@query("suffix_key", _DISTINCT4 + f" SELECT {_P} AS pattern, {_TEXT.format(_without('ranks', '1'))} AS key FROM q")
def suffix_key(spark, d):
    return _distinct(spark, d, 4).select(R.compact(F.col("ranks")).alias("pattern"), R.compact(R.suffix_key(F.col("ranks"))).alias("key"))


@query("project_remove", _DISTINCT4 + f" SELECT {_P} AS pattern, {_TEXT.format(_without('ranks', '2'))} AS key FROM q")
def project_remove(spark, d):
    return _distinct(spark, d, 4).select(R.compact(F.col("ranks")).alias("pattern"), R.compact(R.project_remove(F.col("ranks"), 1)).alias("key"))


@query("is_permutation", _DISTINCT4 + f" SELECT {_P} AS pattern, list_sort(ranks) = range(1, 5) AS fine FROM q")
def is_permutation(spark, d):
    return _distinct(spark, d, 4).select(R.compact(F.col("ranks")).alias("pattern"), R.is_permutation(F.col("ranks")).alias("fine"))


@query(
    "seeds_len2",
    f"WITH {_series(quantities)}, l AS (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS v FROM s) "
    "SELECT series_id, count(*) FILTER (v < value) AS up, count(*) FILTER (v > value) AS down, count(*) FILTER (v = value) AS ties FROM l GROUP BY series_id",
)
def seeds_len2(spark, d):
    first = F.get("ranks", F.lit(0))
    return X.seeds(quantities(spark, d)).groupBy("series_id").agg(F.count_if(first == 1).alias("up"), F.count_if(first == 2).alias("down"), F.count_if(F.col("ranks").isNull()).alias("ties"))


@query("forgetting_weights", f"WITH {_series(orders)} SELECT series_id, pos, round(exp(-(1.0 / n) * ((n - 1) - pos)), 9) AS weight FROM s")
def forgetting_weights(spark, d):
    return X.sized(orders(spark, d)).select("series_id", F.col("pos").cast("long").alias("pos"), F.round(R.weight(F.col("pos"), F.col("n"), X.decay(None)), 9).alias("weight"))


def _shown(patterns: DataFrame, *columns: str) -> DataFrame:
    """Patterns as text, whole numbers as longs, supports to 6 places."""
    out = {"pattern": R.compact(F.col("ranks")), "support": F.round("support", 6), "rank": F.col("rank").cast("long"), "m": F.col("m").cast("long")}
    return patterns.select(*(out.get(c, F.col(c)).alias(c) for c in columns))


@query("pattern_counts", _patterns(orders, 2, 4) + f" SELECT series_id, {_P} AS pattern, n_occ FROM p")
def pattern_counts(spark, d):
    return _shown(X.pattern_counts(X.occurrences(orders(spark, d), 2, 4)), "series_id", "pattern", "n_occ")


@query("pattern_support", _patterns(orders, 2, 4) + f" SELECT series_id, {_P} AS pattern, n_occ, round(support, 6) AS support FROM p")
def pattern_support(spark, d):
    return _shown(X.pattern_supports(X.occurrences(orders(spark, d), 2, 4)), "series_id", "pattern", "n_occ", "support")


@query("weight_prefix", _windows(event_types, 3, 3) + f" SELECT series_id, {_P} AS pattern, pos, round(sum(wt) OVER (PARTITION BY series_id, ranks ORDER BY pos), 6) AS prefix FROM o")
def weight_prefix(spark, d):
    return X.weight_prefixes(X.occurrences(event_types(spark, d), 3, 3)).select("series_id", R.compact(F.col("ranks")).alias("pattern"), F.col("pos").cast("long").alias("pos"), F.round("prefix", 6).alias("prefix"))


@query("occurrences", _windows(events, 3, 3) + f" SELECT series_id, {_P} AS pattern, string_agg((pos + 1)::VARCHAR, ' ' ORDER BY pos) AS ends FROM o GROUP BY series_id, ranks")
def occurrences(spark, d):
    found = X.pattern_ends(X.occurrences(events(spark, d), 3, 3))
    return found.select("series_id", R.compact(F.col("ranks")).alias("pattern"), F.array_join(F.transform(R.one_based(F.col("ends")), lambda e: e.cast("string")), " ").alias("ends"))


_PAIRS3 = _patterns(orders, 3, 3) + f", j AS (SELECT a.series_id, a.ranks AS p, b.ranks AS q FROM p a JOIN p b ON a.series_id = b.series_id AND {_without('a.ranks', '1')} = {_without('b.ranks', '3')})"


def _pairs3(spark, d):
    return J.pair_join(X.pattern_counts(X.occurrences(orders(spark, d), 3, 3)))


@query("pair_join", _PAIRS3 + f" SELECT series_id, {_TEXT.format('p')} AS p, {_TEXT.format('q')} AS q FROM j")
def pair_join(spark, d):
    return _pairs3(spark, d).select("series_id", R.compact(F.col("p")).alias("p"), R.compact(F.col("q")).alias("q"))


@query(
    "pair_nested",
    _PAIRS3 + " SELECT f.series_id, hash_attempts, hash_attempts * hash_attempts AS nested_attempts, compatible_pairs FROM (SELECT series_id, count(*) AS hash_attempts FROM p GROUP BY series_id) f JOIN (SELECT series_id, count(*) AS compatible_pairs FROM j GROUP BY series_id) c USING (series_id)",
)
def pair_nested(spark, d):
    return J.pair_counters(X.pattern_counts(X.occurrences(orders(spark, d), 3, 3)))


@query(
    "fuse_patterns",
    _windows(orders, 3, 3)
    + f""", v AS (SELECT DISTINCT ranks FROM o), a AS (SELECT unnest(range(1, 5)) AS x),
    c AS (SELECT [w.x, x.x, y.x, z.x] AS c FROM a w, a x, a y, a z WHERE w.x <> x.x AND w.x <> y.x AND w.x <> z.x AND x.x <> y.x AND x.x <> z.x AND y.x <> z.x)
    SELECT {_TEXT.format('p.ranks')} AS p, {_TEXT.format('q.ranks')} AS q, {_TEXT.format('c')} AS child FROM c JOIN v p ON p.ranks = {_without('c', '4')} JOIN v q ON q.ranks = {_without('c', '1')}""",
)
def fuse_patterns(spark, d):
    distinct = _distinct(spark, d, 3).withColumn("series_id", F.lit("all"))
    children = J.pair_join(distinct).select("p", "q", F.explode(R.fusions(F.col("p"), F.col("q"))).alias("c"))
    return children.select(R.compact(F.col("p")).alias("p"), R.compact(F.col("q")).alias("q"), R.compact(F.col("c")).alias("child"))


@query("fuse_join", _patterns(quantities, 4, 4) + f" SELECT series_id, {_P} AS pattern, n_occ, round(support, 6) AS support FROM p")
def fuse_join(spark, d):
    return _shown(X.pattern_supports(J.fuse_join(X.occurrences(quantities(spark, d), 3, 3, ends=True))), "series_id", "pattern", "n_occ", "support")


@query(
    "aligned_checks",
    _patterns(orders, 2, 2)
    + f""", j AS (SELECT a.series_id, a.ranks AS p, b.ranks AS q FROM p a JOIN p b ON a.series_id = b.series_id),
    x AS (SELECT j.series_id, p, q, pos + 1 AS v, 0 AS side FROM j JOIN o ON o.series_id = j.series_id AND o.ranks = j.p UNION ALL SELECT j.series_id, p, q, pos, 1 FROM j JOIN o ON o.series_id = j.series_id AND o.ranks = j.q),
    t AS (SELECT series_id, p, q, least(max(v) FILTER (side = 0), max(v) FILTER (side = 1)) AS top FROM x GROUP BY ALL)
    SELECT t.series_id, {_TEXT.format('t.p')} AS p, {_TEXT.format('t.q')} AS q, count(DISTINCT v) FILTER (v <= top) AS checks FROM t JOIN x ON x.series_id = t.series_id AND x.p = t.p AND x.q = t.q GROUP BY t.series_id, t.p, t.q""",
)
def aligned_checks(spark, d):
    occurred = X.occurrences(orders(spark, d), 2, 2)
    found = J.aligned_checks(occurred, J.pair_join(X.pattern_counts(occurred)))
    return found.select("series_id", R.compact(F.col("p")).alias("p"), R.compact(F.col("q")).alias("q"), "checks")


_UB = _windows(orders, 3, 3) + """, g AS (SELECT unnest(range(0, 4)) AS d),
    u AS (SELECT series_id, n, ranks, d, exp((1.0 / n) * d) * coalesce(sum(wt ORDER BY pos) FILTER (pos <= n - 1 - d), 0) AS bound FROM o, g GROUP BY series_id, n, ranks, d)"""


def _profiled(spark, d):
    return B.profiles(X.occurrences(orders(spark, d), 3, 3), 3)


@query("depth_ub", _UB + f" SELECT series_id, {_P} AS pattern, d::BIGINT AS d, round(bound, 6) AS bound FROM u")
def depth_ub(spark, d):
    return B.depth_bounds(_profiled(spark, d)).select("series_id", R.compact(F.col("ranks")).alias("pattern"), F.col("d").cast("long").alias("d"), F.round("bound", 6).alias("bound"))


@query("depth_profile", _UB + f" SELECT series_id, {_P} AS pattern, max(round(bound, 6)) FILTER (d = 0) AS ub0, max(round(bound, 6)) FILTER (d = 1) AS ub1, max(round(bound, 6)) FILTER (d = 2) AS ub2, max(round(bound, 6)) FILTER (d = 3) AS ub3 FROM u GROUP BY series_id, ranks")
def depth_profile(spark, d):
    return _profiled(spark, d).select("series_id", R.compact(F.col("ranks")).alias("pattern"), *(F.round(F.get("ub", F.lit(i)), 6).alias(f"ub{i}") for i in range(4)))


@query("dub", _UB + f" SELECT series_id, {_P} AS pattern, round(max(bound), 6) AS bound FROM u GROUP BY series_id, ranks")
def dub(spark, d):
    return _profiled(spark, d).select("series_id", R.compact(F.col("ranks")).alias("pattern"), F.round(B.dub(F.col("ub")), 6).alias("bound"))


@query("dub_filter", _UB + f" SELECT series_id, {_P} AS pattern, round(max(bound), 6) AS bound FROM u GROUP BY series_id, n, ranks HAVING max(bound) + 1e-12 >= 0.1 * n")
def dub_filter(spark, d):
    """Patterns whose extensions may still reach a least support of a tenth of the series' length."""
    kept = _profiled(spark, d).where(~B.below(B.dub(F.col("ub")), 0.1 * F.col("n")))
    return kept.select("series_id", R.compact(F.col("ranks")).alias("pattern"), F.round(B.dub(F.col("ub")), 6).alias("bound"))


_UB_PAIRS = f"j AS (SELECT a.series_id, a.n, a.ranks AS p, b.ranks AS q FROM (SELECT DISTINCT series_id, n, ranks FROM u) a JOIN (SELECT DISTINCT series_id, ranks FROM u) b ON a.series_id = b.series_id AND {_without('a.ranks', '1')} = {_without('b.ranks', '3')})"


@query(
    "pdub",
    _UB + f", {_UB_PAIRS} SELECT j.series_id, {_TEXT.format('j.p')} AS p, {_TEXT.format('j.q')} AS q, round(max(least(x.bound, y.bound)), 6) AS bound FROM j JOIN u x ON x.series_id = j.series_id AND x.ranks = j.p JOIN u y ON y.series_id = j.series_id AND y.ranks = j.q AND x.d = y.d + 1 GROUP BY j.series_id, j.p, j.q",
)
def pdub(spark, d):
    x = _profiled(spark, d)
    own = x.select("series_id", "ranks", "ub")
    pairs = J.pair_join(x).join(own.toDF("series_id", "p", "ub_p"), ["series_id", "p"]).join(own.toDF("series_id", "q", "ub_q"), ["series_id", "q"])
    return pairs.select("series_id", R.compact(F.col("p")).alias("p"), R.compact(F.col("q")).alias("q"), F.round(B.pdub(F.col("ub_p"), F.col("ub_q")), 6).alias("bound"))


@query(
    "pair_ub",
    _UB + f", {_UB_PAIRS} SELECT j.series_id, {_TEXT.format('j.p')} AS p, {_TEXT.format('j.q')} AS q, round(least(exp(1.0 / j.n) * x.bound, y.bound), 6) AS bound FROM j JOIN u x ON x.series_id = j.series_id AND x.ranks = j.p AND x.d = 0 JOIN u y ON y.series_id = j.series_id AND y.ranks = j.q AND y.d = 0",
)
def pair_ub(spark, d):
    x = _profiled(spark, d)
    own = x.select("series_id", "ranks", "support", "k")
    pairs = J.pair_join(x).join(own.toDF("series_id", "p", "sp", "k"), ["series_id", "p"]).join(own.drop("k").toDF("series_id", "q", "sq"), ["series_id", "q"])
    return pairs.select("series_id", R.compact(F.col("p")).alias("p"), R.compact(F.col("q")).alias("q"), F.round(B.pair_ub(F.col("sp"), F.col("sq"), F.col("k")), 6).alias("bound"))


@query("theta", _top(orders, 2, 4, 10) + " SELECT series_id, round(min(support), 6) AS theta FROM t GROUP BY series_id HAVING count(*) >= 10")
def theta(spark, d):
    return X.theta(M.top_k_one_pass(orders(spark, d), 10, 2, 4), 10).select("series_id", F.round("theta", 6).alias("theta"))


_ANSWER = f" SELECT series_id, rank, {_P} AS pattern, n_occ, round(support, 6) AS support FROM t"
_COLUMNS = ("series_id", "rank", "pattern", "n_occ", "support")


@query("topk_bruteforce", _top(events, 2, 5, 20) + _ANSWER)
def topk_bruteforce(spark, d):
    return _shown(M.mine(events(spark, d), "bruteforce", 20, min_len=2, max_len=5), *_COLUMNS)


@query("topk_hj", _top(orders, 2, 4, 10) + _ANSWER)
def topk_hj(spark, d):
    return _shown(M.mine(orders(spark, d), "hjtopk", 10, min_len=2, max_len=4), *_COLUMNS)


def _pruned(mode: str) -> Query:
    return lambda spark, d: _shown(M.mine(orders(spark, d), mode, 10, min_len=2, max_len=4), *_COLUMNS)


for _name, _mode in (("topk_pruned", "tk"), ("topk_pruned_naive", "tk-naive"), ("topk_dub_only", "tk-no-pdub"), ("topk_pdub_only", "tk-no-dub"), ("topk_no_bounds", "tk-no-bounds")):
    query(_name, _top(orders, 2, 4, 10) + _ANSWER)(_pruned(_mode))


@query("topk_minlen3", _top(events, 3, 5, 10) + _ANSWER)
def topk_minlen3(spark, d):
    return _shown(M.mine(events(spark, d), "tk", 10, min_len=3, max_len=5), *_COLUMNS)


#: A steep decay, under which a pattern can pass a threshold that its parts miss.
_LEAST, _STEEP = 0.5, 0.3
_STEEPLY = _patterns(events, 2, 4).replace("exp(-(1.0 / n)", f"exp(-{_STEEP}")
_LEVELS = _STEEPLY + f""", k2 AS (SELECT * FROM p WHERE m = 2 AND support + 1e-12 >= {_LEAST}),
    k3 AS (SELECT * FROM p WHERE m = 3 AND support + 1e-12 >= {_LEAST} AND EXISTS (SELECT 1 FROM k2 WHERE k2.series_id = p.series_id AND k2.ranks = {_without('p.ranks', '3')}) AND EXISTS (SELECT 1 FROM k2 WHERE k2.series_id = p.series_id AND k2.ranks = {_without('p.ranks', '1')})),
    k4 AS (SELECT * FROM p WHERE m = 4 AND support + 1e-12 >= {_LEAST} AND EXISTS (SELECT 1 FROM k3 WHERE k3.series_id = p.series_id AND k3.ranks = {_without('p.ranks', '4')}) AND EXISTS (SELECT 1 FROM k3 WHERE k3.series_id = p.series_id AND k3.ranks = {_without('p.ranks', '1')})),
    t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY support DESC, m, ranks) AS rank FROM (SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4))"""
for _name, _mode in (("threshold_hj", "hj"), ("threshold_baseline", "baseline")):
    query(_name, _LEVELS + _ANSWER)(lambda spark, d, mode=_mode: _shown(M.mine(events(spark, d), mode, min_sup=_LEAST, max_len=4, k=_STEEP), *_COLUMNS))


@query("threshold_having", _STEEPLY + f", t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY support DESC, m, ranks) AS rank FROM p WHERE support + 1e-12 >= {_LEAST})" + _ANSWER)
def threshold_having(spark, d):
    return _shown(M.threshold_complete(events(spark, d), _LEAST, 4, _STEEP), *_COLUMNS)


def _grid(frames: list[tuple[float, DataFrame]], name: str) -> DataFrame:
    out = None
    for cell, top in frames:
        one = _shown(top, "series_id", "pattern", "support", "rank").withColumn(name, F.lit(float(cell)))
        out = one if out is None else out.unionByName(one)
    return out


@query("sensitivity_K", _top(orders, 2, 4, 8) + ", g AS (SELECT unnest([2, 4, 8]) AS k)" + f" SELECT series_id, {_P} AS pattern, round(support, 6) AS support, rank, k::DOUBLE AS topk FROM t, g WHERE rank <= k")
def sensitivity_topk(spark, d):
    found = X.pattern_supports(X.occurrences(orders(spark, d), 2, 4))
    return _grid([(k, X.top_k(found, k)) for k in (2, 4, 8)], "topk")


@query(
    "sensitivity_L",
    _patterns(orders, 2, 5) + f", g AS (SELECT unnest([3, 4, 5]) AS l) SELECT series_id, {_P} AS pattern, round(support, 6) AS support, row_number() OVER (PARTITION BY series_id, l ORDER BY support DESC, m, ranks) AS rank, l::DOUBLE AS maxlen FROM p, g WHERE m <= l QUALIFY rank <= 5",
)
def sensitivity_l(spark, d):
    found = X.pattern_supports(X.occurrences(orders(spark, d), 2, 5))
    return _grid([(m, X.top_k(found.where(F.col("m") <= m), 5)) for m in (3, 4, 5)], "maxlen")


@query(
    "sensitivity_k",
    _windows(orders, 2, 3)
    + f", g AS (SELECT unnest([0.5, 1, 2]) AS f), p AS (SELECT series_id, f, m, ranks, sum(exp(-(f / n) * ((n - 1) - pos)) ORDER BY pos) AS support FROM o, g GROUP BY series_id, f, m, ranks) "
    f"SELECT series_id, {_P} AS pattern, round(support, 6) AS support, row_number() OVER (PARTITION BY series_id, f ORDER BY support DESC, m, ranks) AS rank, f::DOUBLE AS factor FROM p QUALIFY rank <= 3",
)
def sensitivity_k(spark, d):
    occurred = X.occurrences(orders(spark, d), 2, 3)
    return _grid([(f, X.top_k(X.pattern_supports(occurred, None, f), 3)) for f in (0.5, 1.0, 2.0)], "factor")


_GRID = "(VALUES " + ", ".join(f"('{c.phase}', {c.factor}, {c.topk}, {c.maxlen})" for c in G.CAMPAIGN) + ") AS g(phase, factor, topk, maxlen)"


@query(
    "campaign_grid",
    _windows(orders, 2, 16)
    + f""", f AS (SELECT DISTINCT factor::DOUBLE AS factor FROM {_GRID}),
    p AS (SELECT series_id, n, factor, m, ranks, count(*) AS n_occ, sum(exp(-(factor / n) * ((n - 1) - pos)) ORDER BY pos) AS support FROM o, f GROUP BY series_id, n, factor, m, ranks),
    t AS (SELECT series_id, phase, g.factor::DOUBLE AS factor, topk::BIGINT AS topk, maxlen::BIGINT AS maxlen, m, ranks, n_occ, support, row_number() OVER (PARTITION BY series_id, phase, g.factor, topk, maxlen ORDER BY support DESC, m, ranks) AS rank FROM p JOIN {_GRID} ON g.factor = p.factor AND m <= maxlen AND maxlen <= n QUALIFY rank <= topk)
    SELECT series_id, phase, factor, topk, maxlen, rank, {_P} AS pattern, n_occ, round(support, 6) AS support FROM t""",
)
def campaign_grid(spark, d):
    found = G.campaign(orders(spark, d))
    return _shown(found, "series_id", "phase", "factor", "topk", "maxlen", "rank", "pattern", "n_occ", "support")


@query("mode_agreement", "SELECT DISTINCT o_orderpriority AS dataset, 3::BIGINT AS modes, 1::BIGINT AS digests, TRUE AS agree FROM orders")
def mode_agreement(spark, d):
    series, out = orders(spark, d), None
    for mode in ("hjtopk", "tk", "tk-no-bounds"):
        one = D.digests(M.mine(series, mode, 10, max_len=4), 6).select(F.col("series_id").alias("dataset"), F.lit(mode).alias("mode"), "sha256")
        out = one if out is None else out.unionByName(one)
    return D.agreement(out)


@query("answer_diff", "SELECT 0::BIGINT AS differing")
def answer_diff(spark, d):
    series = orders(spark, d)
    return J.answer_diff(M.mine(series, "hjtopk", 10, max_len=4), M.mine(series, "tk", 10, max_len=4)).agg(F.count(F.lit(1)).alias("differing"))


_LONG = _top(events, 2, 12, 50) + _ANSWER


@query("topk_long", _LONG)
def topk_long(spark, d):
    return _shown(M.top_k_one_pass(events(spark, d), 50, 2, 12), *_COLUMNS)


@query("topk_long_pruned", _LONG)
def topk_long_pruned(spark, d):
    """Length by length, without the windows whose part is below the k-th support so far."""
    found = G.grid_patterns(events(spark, d), [1.0], [50], 2, 12).withColumn("support", F.get("supports", F.lit(0)))
    return _shown(X.top_k(found, 50), *_COLUMNS)


@query("canonical_digest", _top(events, 2, 4, 10) + f" SELECT series_id, n::BIGINT AS n, sha256(string_agg({_P} || chr(9) || printf('%.6f', support) || chr(10), '' ORDER BY rank)) AS sha256 FROM t GROUP BY series_id, n")
def canonical_digest(spark, d):
    return D.digests(M.top_k_one_pass(events(spark, d), 10, 2, 4, ends=True), 6).withColumn("n", F.col("n").cast("long"))


@query("run_median", _LOG + " SELECT dataset, mode, count(*) AS n, round(quantile_cont(runtime_ms, 0.5), 6) AS median FROM r GROUP BY dataset, mode")
def run_median(spark, d):
    return T.medians(run_log(spark, d)).withColumn("median", F.round("median", 6))


@query("run_iqr", _LOG + " SELECT dataset, mode, round(quantile_cont(runtime_ms, 0.25), 6) AS q1, round(quantile_cont(runtime_ms, 0.75), 6) AS q3 FROM r GROUP BY dataset, mode")
def run_iqr(spark, d):
    return T.quartiles(run_log(spark, d)).withColumns({"q1": F.round("q1", 6), "q3": F.round("q3", 6)})


_RATIOS = _LOG + ", q AS (SELECT dataset, quantile_cont(runtime_ms, 0.5) FILTER (mode = '0') AS slow, quantile_cont(runtime_ms, 0.5) FILTER (mode = '1') AS fast FROM r GROUP BY dataset), v AS (SELECT *, slow / fast AS ratio FROM q WHERE slow IS NOT NULL AND fast IS NOT NULL)"


@query("speedup", _RATIOS + " SELECT dataset, round(slow, 6) AS slow, round(fast, 6) AS fast, round(ratio, 6) AS ratio FROM v")
def speedup(spark, d):
    return T.speedups(run_log(spark, d), "0", "1").select("dataset", *(F.round(c, 6).alias(c) for c in ("slow", "fast", "ratio")))


@query("geomean_speedup", _RATIOS + " SELECT round(exp(avg(ln(ratio))), 6) AS geomean FROM v")
def geomean_speedup(spark, d):
    return T.speedups(run_log(spark, d), "0", "1").agg(F.round(T.geomean(F.col("ratio")), 6).alias("geomean"))


@query("wins", _RATIOS + " SELECT count(*) FILTER (ratio > 1) AS wins, count(*) AS datasets FROM v")
def wins(spark, d):
    return T.wins(T.speedups(run_log(spark, d), "0", "1"))


@query("search_space", _LOG + ", m AS (SELECT dataset, mode, quantile_cont(runtime_ms, 0.5) AS v FROM r GROUP BY dataset, mode) SELECT dataset, " + ", ".join(f"round(max(v) FILTER (mode = '{i}'), 6) AS mode{i}" for i in range(5)) + " FROM m GROUP BY dataset")
def search_space(spark, d):
    modes = [str(i) for i in range(5)]
    wide = run_log(spark, d).groupBy("dataset").pivot("mode", modes).agg(F.percentile("runtime_ms", 0.5))
    return wide.select("dataset", *(F.round(F.col(f"`{i}`"), 6).alias(f"mode{i}") for i in modes))


@query(
    "wilcoxon",
    _RATIOS
    + """, x AS (SELECT slow - fast AS d FROM v WHERE slow <> fast), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, row_number() OVER (ORDER BY abs(d), d) - 1 AS i FROM x),
    c AS (SELECT count(*) AS m, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus FROM k), g AS (SELECT unnest(range(0, (1 << m)::BIGINT)) AS s FROM c),
    t AS (SELECT s, coalesce(sum(r) FILTER ((s >> i) & 1 = 1), 0) AS w FROM g, k GROUP BY s)
    SELECT any_value(m)::BIGINT AS m, round(any_value(w_plus), 6)::DOUBLE AS w_plus, round(least(1.0, 2.0 * least(count(*) FILTER (w <= w_plus + 1e-9), count(*) FILTER (w >= w_plus - 1e-9)) / count(*)), 6)::DOUBLE AS p FROM t, c""",
)
def wilcoxon(spark, d):
    diffs = T.speedups(run_log(spark, d), "0", "1").select((F.col("slow") - F.col("fast")).alias("diff"))
    return T.wilcoxon(diffs).select(F.col("m").cast("long").alias("m"), F.round("w_plus", 6).alias("w_plus"), F.round("p", 6).alias("p"))


@query("nearest_factor", _LOG + ", m AS (SELECT dataset, mode::INT * 0.25 AS place, quantile_cont(runtime_ms, 0.5) AS value FROM r GROUP BY ALL) SELECT dataset, place::DOUBLE AS place, round(value, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY abs(place - 0.6), place) = 1")
def nearest_factor(spark, d):
    points = T.medians(run_log(spark, d)).select("dataset", (F.col("mode").cast("int") * 0.25).alias("at"), F.col("median").alias("value"))
    return T.nearest(points, ["dataset"], "at", "value", 0.6).withColumn("value", F.round("value", 6))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return T.bootstrap_median(run_log(spark, d))


@query("search_counters")
def search_counters(spark, d):
    """Counters of the search that visits pairs one by one, for each series."""
    return M.top_k_pruned(orders(spark, d), 10, 2, 5, exact=True).counters


@query(
    "search_counters_all",
    _patterns(orders, 2, 4)
    + f""", pr AS (SELECT a.series_id, a.m, a.ranks AS p, b.ranks AS q FROM p a JOIN p b ON a.series_id = b.series_id AND a.m = b.m AND a.m < 4
      AND {_without('a.ranks', '1')} = list_transform(list_filter(b.ranks, lambda v: v <> b.ranks[b.m]), lambda v: v - (CASE WHEN v > b.ranks[b.m] THEN 1 ELSE 0 END))),
    xs AS (SELECT a.series_id, p, q, pos + 1 AS v, 0 AS side FROM pr a JOIN o ON o.series_id = a.series_id AND o.ranks = a.p UNION ALL SELECT a.series_id, p, q, pos, 1 FROM pr a JOIN o ON o.series_id = a.series_id AND o.ranks = a.q),
    h AS (SELECT series_id, p, q, least(max(v) FILTER (side = 0), max(v) FILTER (side = 1)) AS top FROM xs GROUP BY ALL),
    ck AS (SELECT h.series_id, count(DISTINCT (h.p, h.q, v)) AS aligned_checks FROM h JOIN xs x ON x.series_id = h.series_id AND x.p = h.p AND x.q = h.q AND v <= top GROUP BY h.series_id),
    cp AS (SELECT series_id, count(*) AS compatible_pairs FROM pr GROUP BY series_id)
    SELECT p.series_id, count(*) FILTER (m < 4) AS pair_attempts, any_value(compatible_pairs) AS compatible_pairs, 0::BIGINT AS pdub_prunes, 0::BIGINT AS dub_prunes, count(*) FILTER (m > 2) AS generated_patterns,
      count(*) FILTER (m = 3) AS expanded_patterns, any_value(aligned_checks) AS aligned_checks FROM p JOIN cp USING (series_id) JOIN ck USING (series_id) GROUP BY p.series_id""",
)
def search_counters_all(spark, d):
    """Counters of the search without bounds, which SQL can tell."""
    return M.top_k_pruned(orders(spark, d), 10, 2, 4, use_pdub=False, use_dub=False, exact=True).counters


@query("series_from_text", f"WITH {_series(orders)} SELECT series_id, pos, round(value, 6) AS value FROM s")
def series_from_text(spark, d):
    rows = orders(spark, d).withColumn("chunk", F.floor(F.col("pos") / 500))
    texts = rows.groupBy("series_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("r"))
    text = F.concat(F.array_join(F.transform("r", lambda x: x["value"].cast("string")), " ,"), F.lit(" ;\n"))
    back = S.from_text(texts.select(F.concat_ws("|", "series_id", "chunk").alias("id"), text.alias("t")), F.col("id"), F.col("t"))
    part = F.split("series_id", "\\|")
    return back.select(F.get(part, F.lit(0)).alias("series_id"), (F.col("pos") + 500 * F.get(part, F.lit(1)).cast("long")).alias("pos"), F.round("value", 6).alias("value"))


@query(
    "clean_series",
    "WITH c AS (SELECT event_type AS series_id, event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events) "
    "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY event_id) - 1 AS pos, round(v, 6) AS value FROM c WHERE v IS NOT NULL",
)
def clean_series(spark, d):
    e = _t(spark, d, "events")
    raw = F.when(F.col("event_id") % 7 == 0, ".").when(F.col("event_id") % 11 == 0, "nd").otherwise(F.col("value").cast("string"))
    lines = e.select(F.col("event_type").alias("path"), (F.col("event_id") + 1).alias("line"), F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), raw).alias("t"))
    return S.from_dated_lines(lines).select("series_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(
    "array_series",
    "WITH s AS (SELECT vec_id::VARCHAR AS series_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS value, len(embedding) AS n FROM embeddings),\n"
    + _top(orders, 2, 3, 1).split("FROM orders),", 1)[1]
    + f" SELECT series_id, {_P} AS pattern, round(support, 6) AS support FROM t",
)
def array_series(spark, d):
    series = S.from_arrays(_t(spark, d, "embeddings"), F.col("vec_id"), F.col("embedding"))
    return _shown(M.top_k_one_pass(series, 1, 2, 3), "series_id", "pattern", "support")


@query("dataset_sha")
def dataset_sha(spark, d):
    """Digests of every table's files."""
    return S.file_digests(spark, f"{d}/*.parquet")


@query("series_source", f"WITH {_series(orders)} SELECT series_id, pos, round(value, 6) AS value FROM s")
def series_source(spark, d):
    """Text files of numbers, one a series, joined line by line in many tasks, and read back by small ranges of bytes."""
    lines = orders(spark, d).withColumn("line", F.floor(F.col("pos") / 4096)).groupBy("series_id", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("r"))
    text = F.concat(F.array_join(F.transform("r", lambda x: x["value"].cast("string")), ", "), F.lit(", "))
    texts = lines.select("series_id", "line", text.alias("value")).repartition("series_id").sortWithinPartitions("series_id", "line").drop("line")
    path = scratch_path(spark, "texts")
    texts.write.partitionBy("series_id").text(path)
    back = N.read_series(spark, path, 4096)
    return back.select(F.regexp_extract("series_id", "series_id=([^/]+)/", 1).alias("series_id"), F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return topk_hj(spark, d)
