"""ROC operators and the skew-safe scan against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigspark.operators import roc
from sigspark.operators.scan import ordered_scan


def _pred(spark, seed=1, n=600, hot=True):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(4):
        m = n * 3 if (hot and g == 0) else n  # group 0 holds far more rows than the others
        lab = rng.integers(0, 2, m)
        sc = np.round(rng.normal(lab * 0.7, 1.0, m), 1)  # rounding creates ties
        rows += [("s%d" % g, "m", i, int(lab[i]), float(sc[i])) for i in range(m)]
    return spark.createDataFrame(rows, "study string, model string, rid long, label int, score double")


def _auc_brute(lab, sc):
    pos, neg = sc[lab == 1], sc[lab == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_ordered_scan_matches_window(spark, buckets):
    df = _pred(spark).groupBy("study", "score").agg(F.count(F.lit(1)).alias("c"))
    got = ordered_scan(df, ["study"], ["score"], sums=["c"], fwd=["c"], bwd=["score"], buckets=buckets)
    w = Window.partitionBy("study").orderBy("score")
    ref = df.select(
        "study", "score",
        F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r_cum"),
        F.lag("c").over(w).alias("r_prev"),
        F.lead("score").over(w).alias("r_next"),
    )
    j = got.join(ref, ["study", "score"]).toPandas()
    assert len(j) == df.count()
    assert (j.c_cum == j.r_cum).all()
    assert j.c_prev.fillna(-1).equals(j.r_prev.fillna(-1))
    assert np.allclose(j.score_next.fillna(1e9), j.r_next.fillna(1e9))


def test_auc_brute_force_and_symmetry(spark):
    p = _pred(spark)
    got = {r.study: r.auc for r in roc.auc(p).collect()}
    pdf = p.toPandas()
    for s, g in pdf.groupby("study"):
        assert got[s] == pytest.approx(_auc_brute(g.label.to_numpy(), g.score.to_numpy()), abs=1e-6)
    neg = {r.study: r.auc for r in roc.auc(p.withColumn("score", -F.col("score"))).collect()}
    mono = {r.study: r.auc for r in roc.auc(p.withColumn("score", F.exp("score") * 3 + 1)).collect()}
    for s in got:
        assert neg[s] == pytest.approx(1 - got[s], abs=1e-6)
        assert mono[s] == pytest.approx(got[s], abs=1e-6)


def test_auc_one_class_is_null(spark):
    p = spark.createDataFrame([("a", "m", i, 1, float(i)) for i in range(5)], "study string, model string, rid long, label int, score double")
    assert roc.auc(p).collect()[0].auc is None


def test_auc_auto_flips_direction(spark):
    p = _pred(spark).withColumn("score", -F.col("score"))
    for r in roc.auc_auto(p).collect():
        assert r.direction == ">" and r.auc > 0.5


def test_roc_curve_brute_force(spark):
    p = _pred(spark, n=80, hot=False)
    cur = roc.roc_curve(p).toPandas()
    pdf = p.toPandas()
    for s, g in pdf.groupby("study"):
        c = cur[cur.study == s].sort_values("ord")
        u = np.sort(g.score.unique())
        thr = np.concatenate([[-np.inf], (u[1:] + u[:-1]) / 2, [np.inf]])
        assert np.allclose(c.threshold.to_numpy(), thr, rtol=0, atol=1e-12)
        cases, ctrls = g.score[g.label == 1].to_numpy(), g.score[g.label == 0].to_numpy()
        se = [(cases >= t).mean() for t in thr]
        sp = [(ctrls < t).mean() for t in thr]
        assert np.allclose(c.sensitivity, se, rtol=0, atol=1e-12) and np.allclose(c.specificity, sp, rtol=0, atol=1e-12)


def test_best_threshold_averages_ties(spark):
    # two thresholds (1.5 and 3.5) reach the same Youden index
    rows = [(0, 1.0), (1, 2.0), (0, 3.0), (1, 4.0)]
    p = spark.createDataFrame([("a", "m", i, l, s) for i, (l, s) in enumerate(rows)], "study string, model string, rid long, label int, score double")
    b = roc.best_threshold(roc.roc_curve(p)).collect()[0]
    assert b.n_tied == 2 and b.threshold == pytest.approx((1.5 + 3.5) / 2)


def test_auprc_numeric_integral(spark):
    p = _pred(spark, n=60, hot=False)
    got = {r.study: r.auprc for r in roc.auprc(p).collect()}
    pdf = p.toPandas()
    for s, g in pdf.groupby("study"):
        sc, lab = g.score.to_numpy(), g.label.to_numpy()
        tp = fp = 0.0
        area = 0.0
        for v in np.sort(np.unique(sc))[::-1]:
            dtp, dfp = ((sc == v) & (lab == 1)).sum(), ((sc == v) & (lab == 0)).sum()
            if dtp > 0:  # integrate x/(x + FPa + h (x - TPa)) numerically
                xs = np.linspace(tp, tp + dtp, 20001)
                prec = xs / (xs + fp + dfp / dtp * (xs - tp))
                prec[xs == 0] = dtp / (dtp + dfp)
                area += np.trapezoid(prec, xs)
            tp, fp = tp + dtp, fp + dfp
        assert got[s] == pytest.approx(area / tp, abs=1e-6)


def test_roc_interp_exact_hit_takes_highest(spark):
    p = _pred(spark, n=50, hot=False)
    it = roc.roc_interp(roc.roc_curve(p), n=150).toPandas()
    assert len(it) == 4 * 150
    assert (it[it.j == 0].sensitivity == 1.0).all()  # spec 0 is hit by the -inf point (sens 1)
    assert (it.sensitivity.between(0, 1)).all()


def test_interpolation_thins_the_curve(spark):
    """Points between grid rows do not reach the scan; the neighbours of every grid row, ties and steps included, are the curve's."""
    rng = np.random.default_rng(9)
    for n in (2, 5, 150):
        spec = np.sort(np.concatenate([np.round(rng.random(400), 3), np.arange(n) / (n - 1), rng.random(50) ** 4]))
        sens = np.sort(rng.random(len(spec)))[::-1]
        points = [("s", "m", float(a), float(b)) for a, b in zip(spec, sens)] + [(None, "m", 0.3, 0.9), (None, "m", 0.3, 0.2), ("s", "x", None, 0.5)]
        got = roc.roc_interp(spark.createDataFrame(points, "study string, model string, specificity double, sensitivity double"), n=n)
        rows = {(r.study, r.j): r.sensitivity for r in got.collect()}
        assert len(rows) == 2 * n
        for j in range(n):
            at = j / (n - 1)
            below, above = spec[spec <= at], spec[spec > at]
            if len(below) and below[-1] == at:
                want = sens[spec == at].max()
            elif not len(below) or not len(above):
                want = sens[spec == above[0]].max() if not len(below) else sens[spec == below[-1]].min()
            else:
                lo, hi = sens[spec == below[-1]].min(), sens[spec == above[0]].max()
                want = lo + (at - below[-1]) * (hi - lo) / (above[0] - below[-1])
            assert rows["s", j] == want
            assert rows[None, j] == (0.9 if at <= 0.3 else 0.2)
