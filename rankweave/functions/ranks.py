"""Rank patterns as Column expressions: every function takes and gives columns, none leaves the JVM.

A pattern is an ``array<int>``, a permutation of 1..m; arrays compare element by element, so ordering by
(size, pattern) is the patterns' total order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tie_free(win: Column) -> Column:
    """True if no two values of a window are equal. NaN equals itself."""
    return F.size(F.array_distinct(win)) == F.size(win)


def rank_encode(win: Column) -> Column:
    """Strict rank permutation of a window; null if it has a tie or is empty."""
    return F.when(tie_free(win) & (F.size(win) > 0), F.transform(win, lambda v: F.size(F.filter(win, lambda u: u <= v))))


def is_permutation(r: Column) -> Column:
    return F.array_sort(r) == F.sequence(F.lit(1), F.size(r))


def project_remove(r: Column, at: int | Column) -> Column:
    """The pattern without the element at a 0-based place, ranked anew."""
    gone = F.get(r, F.lit(at) if isinstance(at, int) else at)
    return F.transform(F.filter(r, lambda v: v != gone), lambda v: v - (v > gone).cast("int"))


def prefix_key(r: Column) -> Column:
    return project_remove(r, F.size(r) - 1)


def suffix_key(r: Column) -> Column:
    return project_remove(r, 0)


def fused(p: Column, q: Column, first_less_last: Column) -> Column:
    """The pattern one longer whose first m values have the shape p and whose last m have q."""
    m = F.size(p)
    last = F.get(q, m - 1)
    middle = F.transform(F.slice(p, 2, F.greatest(m - 1, F.lit(0))), lambda v, i: v + (F.get(q, i) > last).cast("int"))
    return F.concat(F.array(F.get(p, F.lit(0)) + (~first_less_last).cast("int")), middle, F.array(last + first_less_last.cast("int")))


def fusions(p: Column, q: Column) -> Column:
    """All patterns, one or two, that p and q fuse to: those that are permutations and project back to p and q."""
    both = F.array(fused(p, q, F.lit(True)), fused(p, q, F.lit(False)))
    return F.filter(both, lambda r: is_permutation(r) & (prefix_key(r) == p) & (suffix_key(r) == q))


def visit_key(r: Column) -> Column:
    """Patterns of one length in the order in which a search meets them that pairs its patterns in order and offers the child with the lower first value first.

    Children of one pattern then come by falling rank of their last value, so the key has, for each prefix, the
    rank of its last value, negated.
    """
    return F.transform(F.sequence(F.lit(2), F.size(r)), lambda j: -F.size(F.filter(F.slice(r, 1, j), lambda u: u <= F.get(r, j - 1))))


def compact(r: Column) -> Column:
    """Text form, as in (1,3,2)."""
    return F.concat(F.lit("("), F.array_join(F.transform(r, lambda v: v.cast("string")), ","), F.lit(")"))


def weight(pos: Column, n: Column, k: Column) -> Column:
    """Forgetting weight of a window's last position: 1 for the newest."""
    return F.exp(-k * ((n - 1) - pos))


def exact_sum(w: Column) -> Column:
    """Sum of weights in [0, 1] that no order of addition changes, with partial sums before the shuffle.

    A weight becomes two whole numbers of 31 bits, so equal sets of weights have equal sums to the last bit, and
    ties between patterns stay ties. Room for 2^32 weights a group; positions are ints, so a series has fewer.
    """
    high = F.floor(w * (1 << 31))
    low = F.floor((w * (1 << 31) - high) * (1 << 31))
    return F.coalesce(F.sum(high) / float(1 << 31) + F.sum(low) / float(1 << 62), F.lit(0.0))


def folded_sum(ends: Column, n: Column, k: Column) -> Column:
    """Sum of weights added in order of position, for digests that depend on the order of addition."""
    return F.aggregate(F.array_sort(ends), F.lit(0.0), lambda a, e: a + F.exp(-k * ((n - 1) - e)))


def one_based(ends: Column) -> Column:
    return F.transform(ends, lambda e: e + 1)
