"""Driver contract and a DuckDB parity check of fast keys at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from sigspark.plans.views import TABLES

SF001 = "/root/testdata/sf0.001"

FAST = [
    "auc", "roc_curve", "auprc", "labelled", "min_cohort", "zero_fill", "missing_features", "common_features",
    "cohort_summary", "to_long", "sig_weighted_mean", "sig_ssgsea", "sig_gsva_ecdf", "param_grid", "feature_bins",
    "split_histogram", "best_split", "stratified_folds", "logit_irls",
]


def test_keys_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 4 and df.columns == ["study", "model", "n_pos", "n_neg", "auc"]


@pytest.mark.parametrize("key", FAST)
def test_oracle_parity(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    df = E.queries()[key](spark, SF001)
    res = con.execute(E.oracle_sql()[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)

    def norm(rows, names):
        idx = sorted(range(len(names)), key=lambda i: names[i])
        out = []
        for r in rows:
            out.append(tuple(round(r[i], 6) if isinstance(r[i], float) else (tuple(r[i]) if isinstance(r[i], list) else r[i]) for i in idx))
        return sorted(out, key=repr)

    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(res.fetchall(), cols)
