"""Comparison operators: logistic IRLS, folds, bootstrap CI, coverage gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import bootstrap, cohort, compare, roc


def test_logit_irls_matches_newton(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(2):
        x = rng.normal(0, 1, 300)
        y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
        rows += [(s, float(a), int(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "study int, x double, y int")
    got = {r.study: (r.b0, r.b1) for r in compare.logit_irls(df, steps=3).collect()}
    for s in range(2):
        d = np.array([(a, b) for t, a, b in rows if t == s])
        X = np.column_stack([np.ones(len(d)), d[:, 0]])
        beta = np.zeros(2)
        for _ in range(3):
            p = 1 / (1 + np.exp(-X @ beta))
            W = p * (1 - p)
            beta = beta + np.linalg.solve(X.T @ (X * W[:, None]), X.T @ (d[:, 1] - p))
        assert got[s] == pytest.approx(tuple(np.round(beta, 6)), abs=2e-6)


def test_folds_balanced_within_class(spark):
    df = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(503)], "row_id long, y int")
    f = compare.stratified_folds(df, k=5).groupBy("y", "fold").count().toPandas()
    for _, g in f.groupby("y"):
        assert len(g) == 5 and g["count"].max() - g["count"].min() <= 1


def test_bootstrap_ci_deterministic_and_ordered(spark):
    rng = np.random.default_rng(2)
    lab = rng.integers(0, 2, 400)
    rows = [("s", "m", i, int(l), float(rng.normal(l, 1))) for i, l in enumerate(lab)]
    p = spark.createDataFrame(rows, "study string, model string, rid long, label int, score double")
    a = bootstrap.auc_bootstrap(p, reps=60, seed=7).collect()[0]
    b = bootstrap.auc_bootstrap(p, reps=60, seed=7).collect()[0]
    auc = roc.auc(p).collect()[0].auc
    assert a == b and a.n_reps == 60
    assert a.auc_lo <= a.auc_med <= a.auc_hi and a.auc_lo < auc < a.auc_hi


def test_coverage_gate_rules(spark):
    expr = spark.createDataFrame(
        [(1, p, g, 1.0) for p in range(20) for g in ["a", "b", "c", "d"]] + [(2, p, g, 1.0) for p in range(10) for g in ["a", "b", "c", "d"]],
        "study int, patientid long, gene string, value double",
    )
    sigs = spark.createDataFrame(
        [("S4", g, 1.0) for g in ["a", "b", "c", "d"]] + [("S5", g, 1.0) for g in ["a", "b", "c", "d", "e"]],
        "signature string, gene string, weight double",
    )
    got = {(r.study, r.signature): r["pass"] for r in cohort.coverage(expr, sigs, n_cutoff=15, sig_perc=0.8).collect()}
    # study 2 is too small; S5 has 4 of 5 genes = 0.8, which is not more than 0.8
    assert got == {(1, "S4"): True, (1, "S5"): False, (2, "S4"): False, (2, "S5"): False}


def test_baseline_rows_are_neither_kept_nor_moved(spark, tmp_path, monkeypatch):
    """The rows of all models are collapsed where they are read; only scores are kept, and the baseline's coefficients travel."""
    from sigspark.plans import q_compare

    rows = [(i, i % 3, "FO"[i % 2], "RAN"[i % 7 % 3], (i * 7 % 11) / 100, float(i * 31 % 97)) for i in range(400)]
    names = "l_orderkey long, l_linenumber int, l_linestatus string, l_returnflag string, l_discount double, l_extendedprice double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []
    auc = q_compare.roc.auc
    monkeypatch.setattr(q_compare.roc, "auc", lambda p: seen.append(p) or auc(p))
    monkeypatch.setattr(q_compare, "BOOT_REPS", 5)
    out = {(r.study, r.family): r for r in q_compare.q_compare_baseline(spark, str(tmp_path)).collect()}
    assert len(out) == 6 and all(r.ci_lo <= r.ci_hi for r in out.values())
    assert all(abs(out[s, "logistic"].auc - 0.5) == pytest.approx(abs(out[s, "discount"].auc - 0.5), abs=2e-6) for s in "FO")
    (p,) = seen
    assert not p.storageLevel.useMemory and not p.storageLevel.useDisk
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
