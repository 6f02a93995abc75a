"""Weighted quantile sketch: bounds against exact ranks, merging in any order, cuts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.operators import sketch as S

POINTS = st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=120)


def holds(s, value, weight):
    """Every value's true rank lies within the bounds that the summary gives."""
    v, w, low, high = s
    assert (np.diff(v) > 0).all()
    for k, x in enumerate(v):
        below, upto = weight[value < x].sum(), weight[value <= x].sum()
        assert low[k] <= below + 1e-9 and upto <= high[k] + 1e-9 and w[k] <= upto - below + 1e-9
    assert high[-1] == pytest.approx(weight.sum())
    # any rank, also of a value that is not held, is known to within the stated error
    slack = S.rank_error(s) * weight.sum() + 1e-9
    for x in np.unique(value):
        k = np.searchsorted(v, x)
        below = weight[value < x].sum()
        lo, hi = ((low[k], high[k] - w[k]) if k < len(v) and v[k] == x else ((low + w)[k - 1] if k else 0.0, (high - w)[k] if k < len(v) else high[-1]))
        assert lo - 1e-9 <= below <= hi + 1e-9 and hi - lo <= slack


@settings(max_examples=150, deadline=None)
@given(st.lists(POINTS, min_size=1, max_size=5), st.integers(2, 12))
def test_bounds_hold_after_any_merges_and_prunes(parts, size):
    arrays = [(np.array([p[0] for p in x], float), np.array([p[1] for p in x], float)) for x in parts]
    value, weight = (np.concatenate(z) for z in zip(*arrays, strict=True))
    whole = S._all([S.exact(*a) for a in arrays])
    assert S.rank_error(whole) == 0
    holds(whole, value, weight)
    pruned = S.prune(S._all([S.prune(S.exact(*a), size) for a in arrays]), size)
    assert len(pruned[0]) <= size + 1
    holds(pruned, value, weight)
    heaviest = max(weight[value == x].sum() for x in np.unique(value)) / weight.sum()
    assert S.rank_error(pruned) <= 2 * (2 / size) + heaviest


def test_error_stays_small_over_many_buffers(monkeypatch):
    monkeypatch.setattr(S, "BUFFER", 500)
    rng = np.random.default_rng(1)
    value, weight = rng.normal(size=60_000), rng.random(60_000) * 0.25
    sketch = S.Sketch(256)
    for k in range(0, 60_000, 100):
        sketch.add(value[k : k + 100], weight[k : k + 100])
    s = sketch.summary()
    assert len(s[0]) <= 257 and S.rank_error(s) < (np.log2(60_000 / 500) + 2) / 256
    order = np.argsort(value)
    rank = np.cumsum(weight[order]) - weight[order]
    at = np.searchsorted(value[order], s[0])
    assert (np.abs((s[2] + s[3] - s[1]) / 2 - rank[at]) <= S.rank_error(s) * weight.sum()).all()


def frame(spark, n, groups=3, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(int(g), k % 2, float(np.round(rng.normal(), 2)), float(rng.integers(1, 5))) for k, g in enumerate(rng.integers(0, groups, n))]
    return rows, spark.createDataFrame(rows, "study long, feature int, value double, weight double").repartition(7)


def exact_cuts(points, bins):
    v, w, low, high = S.exact(np.array([p[0] for p in points]), np.array([p[1] for p in points]))
    out = {}
    for b in range(1, bins):
        over = v[low >= high[-1] * b / bins - 1e-9]
        if len(over):
            out[over[0]] = b
    return {b: c for c, b in out.items()}


def test_cuts_are_exact_on_fine_data(spark):
    rows, df = frame(spark, 4000)
    got = {}
    for r in S.weighted_cuts(df, 16).collect():
        assert r.rank_error == 0
        got.setdefault((r.study, r.feature), {})[r.bin] = r.cut
    assert len(got) == 6
    for (g, f), cuts in got.items():
        assert cuts == exact_cuts([(r[2], r[3]) for r in rows if r[0] == g and r[1] == f], 16)


def test_coarse_summaries_keep_their_error(spark):
    rows, df = frame(spark, 6000, groups=1)
    for r in S.weighted_cuts(df, 8, size=64).collect():
        mine = np.array([(x[2], x[3]) for x in rows if x[1] == r.feature])
        below, total = mine[mine[:, 0] < r.cut, 1].sum(), mine[:, 1].sum()
        tie = mine[mine[:, 0] == r.cut, 1].sum()
        assert 0 < r.rank_error < 0.1
        assert r.bin / 8 * total - r.rank_error * total - 1e-9 <= below + tie and below <= r.bin / 8 * total + (r.rank_error + 1 / 64) * total + tie


def test_odd_rows(spark):
    schema = "study string, feature int, value double, weight double"
    rows = [(None, 0, 1.0, 1.0), (None, 0, 2.0, 1.0), ("a", 0, None, 1.0), ("a", 0, float("nan"), 1.0), ("a", 0, 5.0, 0.0), ("a", 0, 5.0, None), ("b", 1, 3.0, 2.0)]
    got = [(r.study, r.feature, r.bin, r.cut) for r in S.weighted_cuts(spark.createDataFrame(rows, schema), 2).collect()]
    assert got == [(None, 0, 1, 2.0)]  # one value alone begins no second bin
    assert S.weighted_cuts(spark.createDataFrame([], schema), 4).count() == 0
