"""Boosting: trees grown inside a task and level by level, against an exhaustive trainer in plain Python."""

import hashlib
import math

import numpy as np
import pytest

from sigspark.operators import boost as B
from sigspark.operators import cohort_fits as C

GRID = {"nrounds": [2, 4], "eta": [0.3, 0.1], "max_depth": [2, 5], "gamma": [0.0, 0.05], "colsample_bytree": [0.6], "subsample": [0.7, 1.0]}
SCHEMA = "study long, row_id long, features array<double>, y int"


def u(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def brute(rows, name, rounds, eta, max_depth, gamma, colsample_bytree, subsample, lam=1.0, mcw=1.0):
    """Nodes {(tree, node): (depth, feature, cut, default_left, leaf, gain, cover)} and margins by exhaustive search."""
    n_features = len(rows[0][2])
    values = [sorted({r[2][f] for r in rows if r[2][f] is not None}) for f in range(n_features)]
    margin, nodes = {r[1]: 0.0 for r in rows}, {}
    k = max(1, math.floor(colsample_bytree * n_features))
    for rnd in range(1, rounds + 1):
        p = {i: 1 / (1 + math.exp(-m)) for i, m in margin.items()}
        allowed = sorted(sorted(range(n_features), key=lambda f: (u(name, rnd, f), f))[:k])

        def visit(node, depth, inside, sample):
            if not sample:
                return
            g, h = {r[1]: p[r[1]] - r[3] for r in sample}, {r[1]: p[r[1]] * (1 - p[r[1]]) for r in sample}
            gt, ht = math.fsum(g.values()), math.fsum(h.values())
            best = None
            for f in allowed if depth < max_depth else ():
                known = sorted({r[2][f] for r in sample if r[2][f] is not None})
                for v in known[:-1]:
                    for left in (True, False):
                        ids = [r[1] for r in sample if (left if r[2][f] is None else r[2][f] <= v)]
                        gl, hl = math.fsum(g[i] for i in ids), math.fsum(h[i] for i in ids)
                        if hl >= mcw - 1e-9 and ht - hl >= mcw - 1e-9:
                            gain = round(gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam), 9)
                            if best is None or gain > best[0]:
                                best = gain, f, v, left
            if best and best[0] > gamma and best[0] > 1e-6:
                gain, f, v, left = best
                at = values[f].index(v)
                nodes[rnd - 1, node] = (depth, f, (v + values[f][at + 1]) / 2, left, None, gain, ht)
                goes = lambda r: left if r[2][f] is None else r[2][f] <= v
                visit(2 * node + 1, depth + 1, [r for r in inside if goes(r)], [r for r in sample if goes(r)])
                visit(2 * node + 2, depth + 1, [r for r in inside if not goes(r)], [r for r in sample if not goes(r)])
            else:
                leaf = -eta * gt / (ht + lam)
                nodes[rnd - 1, node] = (depth, None, None, None, leaf, None, ht)
                for r in inside:
                    margin[r[1]] += leaf

        visit(0, 0, rows, [r for r in rows if u(name, rnd, r[1]) < subsample])
    return nodes, margin


def cohorts(rng, sizes, n_features=4, missing=0.15):
    rows = []
    for s, n in enumerate(sizes):
        for i in range(n):
            x = [None if rng.random() < missing else float(np.round(rng.normal(), 1)) for _ in range(n_features)]
            rows.append((s, 100 * s + i, x, int((x[0] or 0) + 0.5 * (x[1] or 0) + rng.normal() > 0)))
    return rows


def got_trees(trees):
    out = {}
    for r in trees.collect():
        assert (r.left, r.right) == ((None, None) if r.feature is None else (2 * r.node + 1, 2 * r.node + 2))
        out.setdefault(r.model, {})[r.tree, r.node] = (r.depth, r.feature, r.threshold, r.default_left, r.leaf_value, r.gain, r.cover)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:2] == w[:2] and got[k][3] == w[3]
        for a, b in ((got[k][i], w[i]) for i in (2, 4, 5, 6)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-8)


def params(fits):
    return {r.fit_id: (r.study, {k: r[k] for k in ("eta", "max_depth", "gamma", "colsample_bytree", "subsample")}) for r in fits.collect()}


@pytest.mark.parametrize("method", ["cohort", "keyed"])
def test_both_trainers_against_exhaustive_search(spark, method):
    rows = cohorts(np.random.default_rng(6), [40, 25])
    trees, preds, fits = B.fit_boosted(spark.createDataFrame(rows, SCHEMA).repartition(3), GRID, method=method)
    got, margins = got_trees(trees), {}
    for r in preds.collect():
        margins.setdefault((r.fit_id, r.nrounds), {})[r.row_id] = r.margin
    assert len(params(fits)) == 2 * 16
    for name, (study, p) in params(fits).items():
        mine = [r for r in rows if r[0] == study]
        for n in (2, 4):
            nodes, want = brute(mine, name, n, **p)
            assert margins[name, n] == pytest.approx(want, abs=1e-9)
        same(got[name], nodes)


def test_reference_size_grid_row(spark):
    """260 rounds to depth 9, as many as the reference's grid has."""
    rows = cohorts(np.random.default_rng(8), [30], n_features=3)
    grid = {"nrounds": [10, 260], "eta": [0.3], "max_depth": [9], "gamma": [0.0], "colsample_bytree": [0.8], "subsample": [0.8]}
    trees, preds, _ = B.fit_boosted(spark.createDataFrame(rows, SCHEMA), grid)
    nodes, want = brute(rows, "0:1", 260, 0.3, 9, 0.0, 0.8, 0.8)
    same(got_trees(trees)["0:1"], nodes)
    assert {r.row_id: r.margin for r in preds.where("nrounds = 260").collect()} == pytest.approx(want, abs=1e-8)


def test_whole_reference_grid_of_small_cohorts_in_one_job(spark):
    """All 3,240 settings (540 fits after sharing rounds) of two cohorts; fewer rounds keep the test short."""
    rows = cohorts(np.random.default_rng(9), [27, 30], n_features=5, missing=0.0)
    grid = {**B.REFERENCE_GRID, "nrounds": [1, 2]}
    trees, preds, fits = B.fit_boosted(spark.createDataFrame(rows, SCHEMA), grid)
    assert fits.count() == 2 * 540 and trees.select("model").distinct().count() == 2 * 540
    assert preds.count() == 540 * 2 * 57
    got, by = got_trees(trees), params(fits)
    for name in list(by)[::90]:
        study, p = by[name]
        same(got[name], brute([r for r in rows if r[0] == study], name, 2, **p)[0])


def test_quantile_bins_are_the_same_in_both(spark):
    rows = spark.createDataFrame(cohorts(np.random.default_rng(3), [60]), SCHEMA)
    a, b = (got_trees(B.fit_boosted(rows, GRID, max_bins=7, method=m)[0]) for m in ("cohort", "keyed"))
    for k in a:
        same(a[k], b[k])


def test_a_stopped_fit_goes_on_after_its_last_whole_round(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(cohorts(np.random.default_rng(4), [30, 20]), SCHEMA)
    grid = {**GRID, "eta": [0.3], "gamma": [0.0], "max_depth": [3]}
    whole = got_trees(B.fit_boosted(rows, grid, method="keyed")[0])
    path, real, ran = str(tmp_path / "fit"), B._round, []

    def stops(spark, path, fits, n_features, rnd, *rest):
        ran.append(rnd)
        if rnd == 3 and ran.count(3) == 1:
            real(spark, path, fits, n_features, rnd, *rest)  # killed after its writes, before it is marked
            raise RuntimeError("killed")
        return real(spark, path, fits, n_features, rnd, *rest)

    monkeypatch.setattr(B, "_round", stops)
    with pytest.raises(RuntimeError, match="killed"):
        B.fit_boosted(rows, grid, state_path=path)
    trees, preds, _ = B.fit_boosted(rows, grid, state_path=path)
    assert ran == [1, 2, 3, 3, 4]
    for k, w in got_trees(trees).items():
        same(w, whole[k])
    assert B.fit_boosted(rows, grid, state_path=path)[1].count() == preds.count() and ran == [1, 2, 3, 3, 4]
    with pytest.raises(ValueError, match="another fit"):
        B.fit_boosted(rows, {**grid, "eta": [0.2]}, state_path=path)


def test_the_plan_does_not_grow_with_rounds(spark):
    rows = spark.createDataFrame(cohorts(np.random.default_rng(5), [20]), SCHEMA)
    sizes = []
    for n in (1, 3):
        trees, preds, _ = B.fit_boosted(rows, {**GRID, "nrounds": [n], "eta": [0.3], "gamma": [0.0], "max_depth": [2], "subsample": [1.0]}, method="keyed")
        sizes.append([len(x._jdf.queryExecution().analyzed().toString()) for x in (trees, preds)])
    assert all(abs(a - b) < 40 for a, b in zip(*sizes, strict=True))


def test_siblings_by_subtraction(spark):
    """A child's histogram from its parent's is the one counted from rows."""
    rows = spark.createDataFrame(cohorts(np.random.default_rng(7), [80]), SCHEMA)
    fits = B.fits_of(rows, {**GRID, "eta": [0.3], "gamma": [0.0], "max_depth": [5], "subsample": [0.7]})
    st = B.bin_rows(rows, B.value_bins(rows)).join(fits.select("study", "fit_id", "subsample"), "study").selectExpr(
        "fit_id", "study", "row_id", "cast(y as double) y", "bins", "subsample", "0D as margin"
    )
    st = B.grad_hess(st).withColumn("keep", B.row_keep(1)).selectExpr("*", "0L as node", "cast(null as double) as leaf", "true as build").checkpoint()
    allowed = B.col_sample(fits, 4, 1)
    hist = B.level_histogram(st, allowed, None).checkpoint()
    nxt, _, dec = B.grow_level(st, fits, hist, 0, 1.0, 1.0)
    nxt = nxt.checkpoint()
    key = lambda df: {(r.fit_id, r.node, r.feature, r.bin): (round(r.sg, 9), round(r.sh, 9), r.n) for r in df.collect()}
    less = B.level_histogram(nxt, allowed, (hist, dec))
    assert key(less) == key(B._histogram(nxt.drop("build"), allowed))
    built = nxt.where("build and keep").count()
    assert 0 < built <= nxt.where("keep").count() / 2


def test_empty_and_null_studies(spark):
    rows = cohorts(np.random.default_rng(1), [20]) + [(None, 9000, [1.0, 2.0, 3.0, 4.0], 1)]
    for method in ("cohort", "keyed"):
        _, preds, fits = B.fit_boosted(spark.createDataFrame(rows, SCHEMA), {**GRID, "nrounds": [1]}, method=method)
        assert fits.count() == 16 and preds.count() == 16 * 20
    trees, preds, fits = B.fit_boosted(spark.createDataFrame([], SCHEMA), GRID)
    assert trees.count() == preds.count() == fits.count() == 0
    with pytest.raises(ValueError, match="unknown method"):
        B.fit_boosted(spark.createDataFrame(rows, SCHEMA), GRID, method="fast")


def test_uniform_is_the_column_function(spark):
    from pyspark.sql import functions as F

    from sigspark.functions import md5_uniform

    got = spark.createDataFrame([("a:1", 3, 7), ("a:1", 3, None)], "f string, r int, i long").select("f", "r", "i", md5_uniform(F.col("f"), F.col("r"), F.col("i")).alias("u"))
    assert all(r.u == C.uniform(r.f, r.r, r.i) for r in got.collect())
