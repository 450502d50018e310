"""Counters of the search that visits pairs one by one, against such a search over dictionaries."""

import glob
import math
import random

import pytest

from rankweave.operators import digest as D
from rankweave.plans import mining as M
from rankweave.sources import series as S
from test_engine import frame, shape

#: A text of the S&P 500 series of 2,514 days, where one is at hand.
PUBLIC = [p for p in glob.glob("/root/*/**/*SP500*.txt", recursive=True) if len(open(p).read().split()) == 2514]


def sequential(t, k, topk, lo, hi, use_pdub, use_dub):
    """Counters of a search that takes pairs in order and raises theta with each child."""
    n, hi = len(t), min(hi, len(t))
    w = [math.exp(-k * (n - 1 - e)) for e in range(n)]
    c = dict.fromkeys(M.COUNTERS, 0)
    held = []
    theta = lambda: sorted(held)[-topk] if len(held) >= topk else None
    ub = lambda ends, d: math.exp(k * d) * sum(w[e] for e in ends if e <= n - 1 - d)
    lost = lambda ends, d: use_dub and theta() is not None and max(ub(ends, x) for x in range(d + 1)) + 1e-12 < theta()
    now = {}
    for r in ((1, 2), (2, 1)):
        ends = [e for e in range(1, n) if shape(t[e - 1 : e + 1]) == r]
        if ends:
            now[r] = ends
            if lo <= 2:
                held.append(sum(w[e] for e in ends))
    if hi > 2:
        gone = [r for r, ends in now.items() if lost(ends, hi - 2)]
        c["dub_prunes"] += len(gone)
        now = {r: e for r, e in now.items() if r not in gone}
    for m in range(2, hi):
        after = {}
        for p, x in now.items():
            c["pair_attempts"] += 1
            for q, y in now.items():
                if shape(p[1:]) != shape(q[:-1]):
                    continue
                c["compatible_pairs"] += 1
                if use_pdub and theta() is not None and max(min(ub(x, d + 1), ub(y, d)) for d in range(hi - m)) + 1e-12 < theta():
                    c["pdub_prunes"] += 1
                    continue
                i = j = 0
                children = {}
                while i < len(x) and j < len(y):
                    c["aligned_checks"] += 1
                    if y[j] == x[i] + 1:
                        if (r := shape(t[y[j] - m : y[j] + 1])) is not None:
                            children.setdefault(r, []).append(y[j])
                        i, j = i + 1, j + 1
                    elif y[j] < x[i] + 1:
                        j += 1
                    else:
                        i += 1
                for r in sorted(children, key=lambda r: r[0]):  # the lower first value first
                    c["generated_patterns"] += 1
                    if m + 1 >= lo:
                        held.append(sum(w[e] for e in children[r]))
                    if m + 1 < hi:
                        if lost(children[r], hi - m - 1):
                            c["dub_prunes"] += 1
                        else:
                            after[r] = children[r]
        now = after
        c["expanded_patterns"] += len(now)
    return c


@pytest.mark.parametrize("topk,lo,hi,k,pdub,dub", [(3, 2, 6, 0.1, True, True), (4, 3, 5, 0.05, True, False), (5, 2, 4, 0.3, False, True)])
def test_against_a_sequential_search(spark, topk, lo, hi, k, pdub, dub):
    rng = random.Random(topk)
    many = [rng.sample(range(60), 60), [rng.randrange(6) for _ in range(50)], [rng.random() for _ in range(90)], [1.0] * 7, list(range(12))]
    found = M.top_k_pruned(frame(spark, many), topk, lo, hi, k, use_pdub=pdub, use_dub=dub, exact=True)
    got = {r.series_id: r.asDict() for r in found.counters.collect()}
    for i, t in enumerate(many):
        want = sequential([float(v) for v in t], k, topk, lo, hi, pdub, dub)
        assert {c: got.get(str(i), {}).get(c, 0) for c in M.COUNTERS} == want, i
    plain = M.top_k_one_pass(frame(spark, many), topk, lo, hi, k)
    columns = ("series_id", "rank", "pattern")
    assert sorted(tuple(r[c] for c in columns) for r in found.top.collect()) == sorted(tuple(r[c] for c in columns) for r in plain.collect())


@pytest.mark.skipif(not PUBLIC, reason="the public series is not here")
def test_public_series(spark):
    """The published counters and digest of the S&P 500 series: 50 patterns of 2 to 12 values."""
    series = S.read_text(spark, PUBLIC[0])
    for pdub, want in ((False, (46551, 0, 194)), (True, (41748, 79, 103))):
        found = M.top_k_pruned(series, 50, 2, 12, use_pdub=pdub, exact=True)
        c = found.counters.first()
        assert (c.aligned_checks, c.pdub_prunes, c.dub_prunes) == want
        assert found.top.count() == 50
    answer = M.top_k_one_pass(series, 50, 2, 12, ends=True)
    assert D.digests(answer).first().sha256 == "1a3c473e462fc227f576b2cb0040add9e3cebbc562854a26cc49557bf4801cac"
