"""Every catalogued method is dispatched; an unknown one is an error."""

import pytest

from sigspark.operators import signatures as S


def tables(spark, method):
    expr = spark.createDataFrame([("s", p, f"g{k}", float((p * 7 + k * 3) % 11 + k)) for p in range(20) for k in range(12)], "study string, patientid long, gene string, value double")
    names = list(S.SPECIAL) + ["Plain"]
    sigs = spark.createDataFrame([(n, f"g{k}", 1.0 if k % 2 else -1.0) for n in names for k in range(6)], "signature string, gene string, weight double")
    info = spark.createDataFrame([(n, method if n == "Plain" else S.SPECIFIC) for n in names], "signature string, method string")
    return expr, sigs, info


def test_all_special_signatures_are_scored(spark):
    got = S.score_signatures(*tables(spark, "ssGSEA"), n_cutoff=5)
    per = {r.signature: r["count"] for r in got.groupBy("signature").count().collect()}
    assert per == {n: 20 for n in [*S.SPECIAL, "Plain"]}
    scale = {r.score for r in got.where("signature = 'IPS_Charoentong'").collect()}
    assert scale <= {float(k) for k in range(11)}


def test_ratio_by_hand(spark):
    expr, sigs, _ = tables(spark, "GSVA")
    value = {(r.patientid, r.gene): r.value for r in expr.collect()}
    for r in S.sig_ratio(expr, sigs.where("signature = 'Plain'"), n_cutoff=5).collect():
        up, down = (sum(value[r.patientid, f"g{k}"] for k in ks) / 3 for ks in ((1, 3, 5), (0, 2, 4)))
        assert r.score == pytest.approx(up / down) if down else r.score is None


@pytest.mark.parametrize("method", ["No such method", None, S.SPECIFIC])
def test_unknown_method_is_an_error(spark, method):
    with pytest.raises(ValueError, match="Plain"):
        S.score_signatures(*tables(spark, method))
