"""Signature scores against explicit per-sample walks and exact kernel CDFs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import signatures as S
from sigspark.operators.kernel import kernel_cdf

GENES = [f"g{i:02d}" for i in range(12)]


def _expr(spark, seed=3, n_samples=20, studies=2):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(studies):
        for p in range(n_samples):
            for g in GENES:
                rows.append((s, s * 1000 + p, g, float(np.round(rng.normal(5, 2), 2))))
    return spark.createDataFrame(rows, "study int, patientid long, gene string, value double")


def _sigs(spark):
    rows = [("A", g, 1.0) for g in GENES[:4]] + [("B", g, -1.0 if i % 2 else 1.0) for i, g in enumerate(GENES[3:9])]
    return spark.createDataFrame(rows, "signature string, gene string, weight double")


NOGATE = dict(n_cutoff=0, sig_perc=None)


def _walk_ssgsea(vals: pd.Series, gset, alpha=0.25):
    order = sorted(vals.index, key=lambda g: (vals[g], g))  # rank 1 = lowest (ties by gene)
    rank = {g: i + 1 for i, g in enumerate(order)}
    walk_order = list(reversed(order))
    ins = np.array([g in gset for g in walk_order])
    r = np.array([rank[g] for g in walk_order], dtype=float)
    p_in = np.cumsum(np.where(ins, r ** alpha, 0)) / np.sum(np.where(ins, r ** alpha, 0))
    p_out = np.cumsum(~ins) / np.sum(~ins)
    return np.sum(p_in - p_out)


def _walk_ks(dens: pd.Series, gset, tau=1.0):
    order = sorted(dens.index, key=lambda g: (-dens[g], g))
    n = len(order)
    w = {g: abs(n - p - n / 2) for p, g in enumerate(order)}  # p is 0-based here: |N - (p+1) + 1 - N/2|
    ins = np.array([g in gset for g in order])
    step_in = np.where(ins, np.array([w[g] ** tau for g in order]), 0)
    rs = np.cumsum(step_in) / step_in.sum() - np.cumsum(~ins) / np.sum(~ins)
    return max(rs.max(), 0) + min(rs.min(), 0)


def test_ssgsea_closed_form_equals_walk(spark):
    e, s = _expr(spark), _sigs(spark)
    got = S.sig_ssgsea(e, s, norm=False, **NOGATE).toPandas()
    pe = e.toPandas()
    sets = {k: set(v.gene) for k, v in s.toPandas().groupby("signature")}
    for (st, pid), g in pe.groupby(["study", "patientid"]):
        vals = g.set_index("gene").value
        for sig, gs in sets.items():
            ref = _walk_ssgsea(vals, gs)
            v = got[(got.study == st) & (got.patientid == pid) & (got.signature == sig)].score.iloc[0]
            assert v == pytest.approx(ref, abs=2e-6)


def test_gsva_ecdf_walk(spark):
    e, s = _expr(spark), _sigs(spark)
    got = S.sig_gsva(e, s, kcdf="none", **NOGATE).toPandas()
    pe = e.toPandas()
    pe["cdf"] = pe.groupby(["study", "gene"]).value.transform(lambda v: v.apply(lambda x: (v <= x).mean()))
    sets = {k: set(v.gene) for k, v in s.toPandas().groupby("signature")}
    for (st, pid), g in pe.groupby(["study", "patientid"]):
        dens = g.set_index("gene").cdf
        for sig, gs in sets.items():
            v = got[(got.study == st) & (got.patientid == pid) & (got.signature == sig)].score.iloc[0]
            assert v == pytest.approx(_walk_ks(dens, gs), abs=2e-6)


def test_kernel_cdf_exact(spark):
    e = _expr(spark, n_samples=40)
    got = kernel_cdf(e).toPandas()
    pe = e.toPandas()
    phi = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    m = pe.merge(got, on=["study", "patientid", "gene"])
    assert len(m) == len(pe)
    for (_, _), g in m.groupby(["study", "gene"]):
        v = g.value.to_numpy()
        h = np.std(v, ddof=1) / 4
        ref = phi((v[:, None] - v[None, :]) / h).mean(axis=1)
        assert np.max(np.abs(g.cdf.to_numpy() - ref)) < 1e-12


def test_weighted_mean_centred_per_study(spark):
    e, s = _expr(spark), _sigs(spark)
    got = S.sig_weighted_mean(e, s, **NOGATE).toPandas()
    assert np.allclose(got.groupby(["study", "signature"]).score.mean(), 0, atol=1e-5)


def test_composite_null_when_component_missing(spark):
    sc = spark.createDataFrame(
        [(0, 1, "A", 1.0), (0, 1, "B", 2.0), (0, 2, "A", 3.0), (0, 2, "B", None)],
        "study int, patientid long, signature string, score double",
    )
    parts = spark.createDataFrame([("C", "A", "add", 1.0), ("C", "B", "add", -2.0)], "signature string, component string, op string, coef double")
    got = {r.patientid: r.score for r in S.sig_composite(sc, parts).collect()}
    assert got[1] == pytest.approx(-3.0) and got[2] is None


def test_gates_null_small_studies(spark):
    e, s = _expr(spark, n_samples=10), _sigs(spark)
    got = S.sig_weighted_mean(e, s, n_cutoff=15, sig_perc=0.8).toPandas()
    assert got.score.isna().all()
