"""Missing feature values in training and scoring; documents that are scored; ties, keys and folds that rounding or names broke."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import boost as B
from sigspark.operators import bootstrap
from sigspark.operators import compare as C
from sigspark.operators import roc
from sigspark.operators import trees as TR

GRID = {"nrounds": [1, 3], "eta": [0.4], "max_depth": [3], "gamma": [0.0], "colsample_bytree": [1.0], "subsample": [1.0]}


def cohort(n=120, share=0.25, seed=3):
    """Rows whose label follows feature 0, and whether feature 1 is known."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=3)
        lost = rng.random(3) < share
        y = int(x[0] + 1.5 * lost[1] + 0.3 * rng.normal() > 0.5)
        rows.append(("s", i, [None if m else float(v) for v, m in zip(x, lost)], y))
    rows.append(("s", n, [None, None, None], 1))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "study string, row_id long, features array<double>, y int")


@pytest.fixture(scope="module")
def fitted(spark):
    rows = cohort()
    df = frame(spark, rows)
    trees, preds, _ = B.fit_boosted(df, GRID)
    return rows, df, trees.cache(), preds.cache()


def test_bins_keep_their_place(spark):
    df = frame(spark, [("s", 1, [1.0, 5.0, 100.0], 0), ("s", 2, [2.0, None, 200.0], 1), ("s", 3, [None, None, None], 1)])
    got = {r.row_id: r.bins for r in B.bin_rows(df, B.value_bins(df)).collect()}
    assert got == {1: [0, 0, 0], 2: [1, None, 1], 3: [None, None, None]}


def test_more_values_than_any_bin_number(spark):
    df = frame(spark, [("s", i, [float(i)], i % 2) for i in range(300)])
    assert B.feature_bins(df).count() == 300 and B.feature_bins(df, 32).count() == 32


def test_root_split_tries_both_directions(fitted):
    rows, _, trees, _ = fitted
    y = np.array([r[3] for r in rows], float)
    g, h = 0.5 - y, np.full(len(y), 0.25)
    best = (-1.0, None, None, None)
    for f in range(3):
        x = np.array([np.nan if r[2][f] is None else r[2][f] for r in rows])
        values = np.unique(x[~np.isnan(x)])
        for cut in (values[1:] + values[:-1]) / 2:
            for left_if_missing in (True, False):
                left = np.where(np.isnan(x), left_if_missing, x < cut)
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = g.sum() - gl, h.sum() - hl
                if hl >= 1 and hr >= 1:
                    gain = round(gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 9)
                    if gain > best[0]:
                        best = (gain, f, cut, left_if_missing)
    root = trees.where("tree = 0 and node = 0").first()
    assert (root.feature, root.default_left) == (best[1], best[3]) and root.threshold == pytest.approx(best[2]) and root.gain == pytest.approx(best[0])
    assert trees.where("feature is not null and threshold is null").count() == 0
    assert trees.where("not default_left").count() > 0


def test_scores_are_the_training_margins(fitted):
    _, df, trees, preds = fitted
    scored = {r.row_id: r.margin for r in TR.score_models(trees, df).collect()}
    trained = {r.row_id: r.margin for r in preds.where("nrounds = 3").collect()}
    assert scored.keys() == trained.keys() and all(scored[i] == pytest.approx(trained[i], abs=1e-9) for i in scored)


def test_documents_read_back_merge_and_score(spark, fitted, tmp_path):
    _, df, trees, _ = fitted
    TR.write_models(TR.model_to_json(trees), str(tmp_path / "models"))
    back = TR.read_models(spark, str(tmp_path / "models"))
    want = {r.row_id: r.margin for r in TR.score_models(trees, df).collect()}
    for t in (back, TR.merge_models(back)):
        got = {r.row_id: r.margin for r in TR.score_models(t, df).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    depth = TR.with_depth(back).agg(F.max("depth")).first()[0]
    assert depth == trees.agg(F.max("depth")).first()[0]


def test_single_leaf_tree(spark):
    df = frame(spark, [("s", i, [1.0, None, 2.0], 1) for i in range(5)])
    trees, preds, _ = B.fit_boosted(df, {**GRID, "nrounds": [1]})
    assert trees.where("feature is not null").count() == 0
    assert {round(r.margin, 9) for r in TR.score_models(trees, df).collect()} == {round(r.margin, 9) for r in preds.collect()}


def test_close_scores_have_a_threshold_between_them(spark):
    rows = [("s", "m", int(i >= 10), 0.3 + i * 1e-8) for i in range(20)]
    pred = spark.createDataFrame(rows, "study string, model string, label int, score double")
    best = roc.best_threshold(roc.roc_curve(pred))
    r = best.first()
    assert rows[9][3] < r.threshold < rows[10][3] and r.youden == 2 and r.n_tied == 1
    m = roc.confusion(pred, best).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (10, 0, 0, 10)


@pytest.mark.parametrize("buckets", [None, 4])
def test_a_null_study_is_a_group(spark, buckets):
    rows = [(s, "m", i % 2, float(i * 7 % 11)) for s in (None, "a") for i in range(20)]
    pred = spark.createDataFrame(rows, "study string, model string, label int, score double")
    for df in (roc.auc(pred, buckets=buckets), roc.auc_auto(pred, buckets=buckets), roc.auprc(pred, buckets=buckets)):
        got = {r.study: r[df.columns[-1]] for r in df.collect()}
        assert got.keys() == {None, "a"} and got[None] == got["a"]
    assert roc.roc_curve(pred, buckets=buckets).where("study is null").count() == 12


def test_folds_of_pooled_studies_keep_every_row_once(spark):
    df = spark.createDataFrame([(s, i, [float(i)], i % 2) for s in range(3) for i in range(10)], "study long, row_id long, features array<double>, y int")
    got = C.stratified_folds(df, 5).collect()
    assert len(got) == 30 and len({(r.study, r.row_id) for r in got}) == 30
    per = {(f, y): sum(r.fold == f and r.y == y for r in got) for f in range(5) for y in (0, 1)}
    assert set(per.values()) == {3}


def test_bootstrap_takes_text_ids(spark):
    rng = np.random.default_rng(1)
    rows = [("s", "m", f"Pt{i}", i % 2, float(rng.normal() + i % 2)) for i in range(80)]
    pred = spark.createDataFrame(rows, "study string, model string, rid string, label int, score double")
    r = bootstrap.auc_bootstrap(pred, reps=100).first()
    true = roc.auc(pred).first().auc
    assert r.n_reps == 100 and r.auc_lo < true < r.auc_hi and r.auc_hi - r.auc_lo > 0.05
