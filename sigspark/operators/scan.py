"""Skew-safe ordered scan within groups.

Running sums, "previous non-null" and "next non-null" values along an order
inside a group are the backbone of ROC curves, AUC, AUPRC, medians and
curve interpolation.  A plain window partitioned by the group key puts a
whole group into one task, which breaks when one study/model holds a large
share of the rows.  ``ordered_scan`` splits every group into quantile
buckets of its leading order column:

1. per group, ``percentile_approx`` gives ``buckets - 1`` cut points
   (a mergeable sketch: partial aggregation, no group is gathered); the pass
   that sketches also counts, and where no group needs a second bucket, plain
   windows do;
2. each row gets its bucket id = number of cut points strictly below it, so
   ties on the leading order column never straddle buckets;
3. a bucket-level table (at most ``buckets`` rows per group) carries the
   bucket totals, last and first non-null values; a window over *buckets*
   turns them into offsets;
4. the row-level window is partitioned by (group, bucket) and adds the
   offsets, so the largest task holds about ``group_size / buckets`` rows.

Results are exact whatever the cut points are: bucketing only changes how
the work is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_UNB = Window.unboundedPreceding

#: Rows of a window task, and the most cut points of a group (beyond them a bucket grows; nothing is dropped).
ROWS_PER_BUCKET, MAX_BUCKETS = 1 << 16, 256


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the keys come from the left side."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(r[f"_r_{k}"])
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    fwd: Sequence[str] = (),
    bwd: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Add scan columns to ``df`` along ``order`` within ``keys``.

    * ``<c>_cum``  for c in ``sums``: inclusive running sum of c.
    * ``<c>_prev`` for c in ``fwd``: last non-null c strictly before the row.
    * ``<c>_next`` for c in ``bwd``: first non-null c strictly after the row.

    ``order`` columns must give a total order within a group (callers collapse
    ties first); the first one must be numeric (it drives the bucketing).
    Keys are compared null-safe: rows with a NULL key form a group of their own.
    ``buckets`` defaults to the largest group's rows / ROWS_PER_BUCKET.
    """
    from ..session import reuse

    keys, order = list(keys), list(order)
    o0 = order[0]
    ordkey = [F.col(o) for o in order]
    v = F.col(o0).cast("double")
    df = reuse(df)  # read by the cut-point sketch, the bucket totals and the row pass
    sketch = None
    if buckets is None:
        # one pass counts the groups and sketches them; its small result also gives the cut points
        at = [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)]
        sketch = reuse(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(v, F.array(*[F.lit(q) for q in at]), 10000).alias("_sb")))
        largest = sketch.agg(F.max("_n")).first()[0] or 0
        buckets = min(MAX_BUCKETS, -(-largest // ROWS_PER_BUCKET))
    if buckets <= 1:  # every group is a window of its own
        return _scan_windows(df, keys, ordkey, order, sums, fwd, bwd)
    if sketch is None:
        qs = [i / buckets for i in range(1, buckets)]
        bounds = df.groupBy(*keys).agg(F.percentile_approx(v, F.array(*[F.lit(q) for q in qs]), 10000).alias("_sb"))
    else:
        cut = [F.element_at("_sb", max(1, round(i * MAX_BUCKETS / buckets))) for i in range(1, buckets)]
        bounds = sketch.select(*keys, F.array(*cut).alias("_sb"))
    # bucket = number of cut points strictly below the value, unrolled over the
    # fixed number of cut points so it stays plain generated code (no lambda)
    sk = sum((F.when(F.element_at(F.col("_sb"), i) < v, 1).otherwise(0) for i in range(1, buckets)), F.lit(0))
    x = null_safe_join(df, bounds, keys).withColumn("_sk", sk).drop("_sb")

    x = reuse(x)  # read by the bucket totals and by the row pass
    aggs = []
    for c in sums:
        aggs.append(F.sum(c).alias(f"_t_{c}"))
    for c in fwd:
        aggs.append(F.max(F.when(F.col(c).isNotNull(), F.struct(*ordkey, F.col(c).alias("_v")))).alias(f"_l_{c}"))
    for c in bwd:
        aggs.append(F.min(F.when(F.col(c).isNotNull(), F.struct(*ordkey, F.col(c).alias("_v")))).alias(f"_f_{c}"))
    bt = x.groupBy(*keys, "_sk").agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy("_sk")
    wb_rev = Window.partitionBy(*keys).orderBy(F.col("_sk").desc())
    sel = [*keys, "_sk"]
    for c in sums:
        sel.append(F.coalesce(F.sum(f"_t_{c}").over(wb.rowsBetween(_UNB, -1)), F.lit(0)).alias(f"_o_{c}"))
    for c in fwd:
        sel.append(F.last(f"_l_{c}", ignorenulls=True).over(wb.rowsBetween(_UNB, -1))["_v"].alias(f"_p_{c}"))
    for c in bwd:
        sel.append(F.last(f"_f_{c}", ignorenulls=True).over(wb_rev.rowsBetween(_UNB, -1))["_v"].alias(f"_n_{c}"))
    bt = bt.select(*sel)

    x = null_safe_join(x, bt, [*keys, "_sk"])
    wi = Window.partitionBy(*keys, "_sk").orderBy(*ordkey)
    wi_rev = Window.partitionBy(*keys, "_sk").orderBy(*[F.col(o).desc() for o in order])
    for c in sums:
        x = x.withColumn(f"{c}_cum", F.col(f"_o_{c}") + F.sum(c).over(wi.rowsBetween(_UNB, 0)))
    for c in fwd:
        x = x.withColumn(
            f"{c}_prev", F.coalesce(F.last(c, ignorenulls=True).over(wi.rowsBetween(_UNB, -1)), F.col(f"_p_{c}"))
        )
    for c in bwd:
        x = x.withColumn(
            f"{c}_next", F.coalesce(F.last(c, ignorenulls=True).over(wi_rev.rowsBetween(_UNB, -1)), F.col(f"_n_{c}"))
        )
    drop = ["_sk"] + [f"_o_{c}" for c in sums] + [f"_p_{c}" for c in fwd] + [f"_n_{c}" for c in bwd]
    return x.drop(*drop)


def _scan_windows(x: DataFrame, keys: list[str], ordkey: list, order: list[str], sums: Sequence[str], fwd: Sequence[str], bwd: Sequence[str]) -> DataFrame:
    """The scan as plain windows over the groups."""
    w = Window.partitionBy(*keys).orderBy(*ordkey)
    back = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    for c in sums:
        x = x.withColumn(f"{c}_cum", F.sum(c).over(w.rowsBetween(_UNB, 0)))
    for c in fwd:
        x = x.withColumn(f"{c}_prev", F.last(c, ignorenulls=True).over(w.rowsBetween(_UNB, -1)))
    for c in bwd:
        x = x.withColumn(f"{c}_next", F.last(c, ignorenulls=True).over(back.rowsBetween(_UNB, -1)))
    return x
