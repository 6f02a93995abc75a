"""Randomised check: the bucketed scan equals a plain window for any cut points."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigspark.operators.scan import ordered_scan


@settings(max_examples=6, deadline=None)
@given(
    sizes=st.lists(st.integers(1, 300), min_size=1, max_size=4),
    buckets=st.sampled_from([1, 2, 7, 32]),
    distinct=st.integers(1, 50),
    seed=st.integers(0, 10_000),
)
def test_scan_equals_window(spark, sizes, buckets, distinct, seed):
    rng = np.random.default_rng(seed)
    sizes = sizes + [sum(sizes) * 2]  # one group holds most of the rows
    rows = []
    for g, n in enumerate(sizes):
        vals = rng.integers(0, distinct, n)
        for i, v in enumerate(vals):
            rows.append((g, float(v), i, int(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "g int, v double, i int, w int")
    got = ordered_scan(df, ["g"], ["v", "i"], sums=["w"], fwd=["w"], bwd=["v"], buckets=buckets)
    win = Window.partitionBy("g").orderBy("v", "i")
    ref = df.select(
        "g", "i",
        F.sum("w").over(win.rowsBetween(Window.unboundedPreceding, 0)).alias("r_cum"),
        F.lag("w").over(win).alias("r_prev"),
        F.lead("v").over(win).alias("r_next"),
    )
    j = got.join(ref, ["g", "i"]).toPandas()
    assert len(j) == len(rows)
    assert (j.w_cum == j.r_cum).all()
    assert j.w_prev.fillna(-1).equals(j.r_prev.fillna(-1))
    assert j.v_next.fillna(-1).equals(j.r_next.fillna(-1))
