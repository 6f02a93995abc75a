"""ROC analytics over a prediction table ``pred(keys..., label, score)``.

Label convention (kept from the reference): 0 = responder ``R`` (the
control level), 1 = non-responder (the case level); scores are P(label=1),
so the default direction ``"<"`` means controls score lower than cases.

Every operator first collapses ties into one row per (group, score) with
class counts (a map-side combined aggregate), then walks the scores with the
skew-safe :func:`ordered_scan`.  No operator gathers a group into one task,
and no operator pairs rows with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse
from .scan import null_safe_join, ordered_scan

KEYS = ("study", "model")


def collapse(pred: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", score: str = "score") -> DataFrame:
    """One row per (group, distinct score) with ``pos`` (label 1) and ``neg`` (label 0) counts."""
    lab = F.col(label)
    return reuse(
        pred.where(lab.isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.when(lab == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(lab == 0, 1).otherwise(0)).alias("neg"),
        )
    )


def _totals(c: DataFrame, keys) -> DataFrame:
    return c.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def auc(pred: DataFrame, keys: Sequence[str] = KEYS, direction: str = "<", buckets: int | None = None) -> DataFrame:
    """Mann-Whitney AUC with ties counted one half.

    AUC = sum over cases of (#controls below + 1/2 #controls tied) / (n1 * n0);
    ``direction=">"`` gives 1 - that.  A group with one class only -> NULL.
    Output: keys, n_pos, n_neg, auc.
    """
    keys = list(keys)
    c = ordered_scan(collapse(pred, keys), keys, ["score"], sums=["neg"], buckets=buckets)
    g = c.groupBy(*keys).agg(
        F.sum(F.col("pos") * ((F.col("neg_cum") - F.col("neg")) + F.col("neg") * 0.5)).alias("u"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    a = F.try_divide(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg"))
    if direction == ">":
        a = F.lit(1.0) - a
    return g.select(*keys, "n_pos", "n_neg", a.alias("auc"))


def _median_at(cum: str, n: str, score: str = "score"):
    """Type-7 median from a running count: mean of the lo-th and hi-th values (0-based)."""
    lo = F.floor((F.col(n) - 1) / 2)
    hi = F.ceil((F.col(n) - 1) / 2)
    v_lo = F.min(F.when(F.col(cum) >= lo + 1, F.col(score)))
    v_hi = F.min(F.when(F.col(cum) >= hi + 1, F.col(score)))
    return (v_lo + v_hi) / 2


def auc_auto(pred: DataFrame, keys: Sequence[str] = KEYS, buckets: int | None = None) -> DataFrame:
    """AUC with automatic direction: ``">"`` when median(controls) > median(cases).

    Medians are read off the same scan (type-7 quantile), so no exact
    percentile buffer per group is needed.  Output: keys, direction, auc.
    """
    keys = list(keys)
    c = collapse(pred, keys)
    s = null_safe_join(ordered_scan(c, keys, ["score"], sums=["neg", "pos"], buckets=buckets), _totals(c, keys), keys)
    g = s.groupBy(*keys).agg(
        F.sum(F.col("pos") * ((F.col("neg_cum") - F.col("neg")) + F.col("neg") * 0.5)).alias("u"),
        F.first("n_pos").alias("n_pos"),
        F.first("n_neg").alias("n_neg"),
        _median_at("neg_cum", "n_neg").alias("med_ctrl"),
        _median_at("pos_cum", "n_pos").alias("med_case"),
    )
    a = F.try_divide(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg"))
    flip = F.col("med_ctrl") > F.col("med_case")
    return g.select(
        *keys,
        F.when(flip, F.lit(">")).otherwise(F.lit("<")).alias("direction"),
        F.when(flip, F.lit(1.0) - a).otherwise(a).alias("auc"),
    )


def roc_curve(pred: DataFrame, keys: Sequence[str] = KEYS, buckets: int | None = None) -> DataFrame:
    """ROC points: thresholds -inf, midpoints of neighbouring distinct scores, +inf.

    For threshold t: sensitivity = #cases >= t / n1, specificity = #controls < t / n0.
    ``ord`` numbers points by increasing threshold (1 = -inf).  ``youden_num`` is
    the whole number (sensitivity + specificity) n1 n0, on which ties are exact.
    Output: keys, ord, threshold, sensitivity, specificity, youden_num.
    """
    keys = list(keys)
    c = collapse(pred, keys).withColumn("one", F.lit(1))
    s = ordered_scan(c, keys, ["score"], sums=["pos", "neg", "one"], bwd=["score"], buckets=buckets)
    s = null_safe_join(s, _totals(c, keys), keys)
    thr = F.when(F.col("score_next").isNull(), F.lit(float("inf"))).otherwise(
        (F.col("score") + F.col("score_next")) / 2
    )
    pts = s.select(
        *keys,
        (F.col("one_cum") + 1).alias("ord"),
        thr.alias("threshold"),
        F.try_divide(F.col("n_pos") - F.col("pos_cum"), F.col("n_pos")).alias("sensitivity"),
        F.try_divide(F.col("neg_cum"), F.col("n_neg")).alias("specificity"),
        (_whole(F.col("n_pos") - F.col("pos_cum")) * _whole(F.col("n_neg")) + _whole(F.col("neg_cum")) * _whole(F.col("n_pos"))).alias("youden_num"),
    )
    first = (
        c.groupBy(*keys)
        .agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        .select(
            *keys,
            F.lit(1).cast("bigint").alias("ord"),
            F.lit(float("-inf")).alias("threshold"),
            F.when(F.col("n_pos") > 0, F.lit(1.0)).alias("sensitivity"),
            F.when(F.col("n_neg") > 0, F.lit(0.0)).alias("specificity"),
            (_whole(F.col("n_pos")) * _whole(F.col("n_neg"))).alias("youden_num"),
        )
    )
    return pts.unionByName(first)


def _whole(col):
    """Counts as decimals, so that the product of two is exact."""
    return col.cast("decimal(18,0)")


def best_threshold(roc: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Youden's J: the threshold(s) maximising sensitivity + specificity.

    Ties, exact on ``youden_num``, are averaged (finite thresholds only).  Pre-aggregates by
    (group, J) before picking the maximum, so no join back to the curve.
    Output: keys, threshold, youden, n_tied.
    """
    keys = list(keys)
    fin = roc.where(~F.col("threshold").isin(float("inf"), float("-inf")) & F.col("sensitivity").isNotNull())
    per_j = fin.groupBy(*keys, "youden_num").agg(
        F.sum("threshold").alias("t_sum"),
        F.count(F.lit(1)).alias("n_tied"),
        F.max(F.col("sensitivity") + F.col("specificity")).alias("youden"),
    )
    best = per_j.groupBy(*keys).agg(F.max_by(F.struct("t_sum", "n_tied", "youden"), "youden_num").alias("b"))
    return best.select(*keys, (F.col("b.t_sum") / F.col("b.n_tied")).alias("threshold"), F.col("b.youden").alias("youden"), F.col("b.n_tied").alias("n_tied"))


def confusion(pred: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Confusion counts at a per-group threshold: predict 1 when score >= threshold.

    The positive class is 0 (``R``), the first factor level, as in the
    reference's metric call.  ``thresholds`` holds one row per group, so
    the join is an equi-join against a table of at most #groups rows.
    Output: keys, threshold, tp, fp, fn, tn.
    """
    keys = list(keys)
    t = thresholds.select(*keys, "threshold")
    x = pred.where(F.col("label").isNotNull() & F.col("score").isNotNull())
    x = null_safe_join(x, t, keys)
    p = F.when(F.col("score") >= F.col("threshold"), 1).otherwise(0)
    lab = F.col("label")
    return x.groupBy(*keys, "threshold").agg(
        F.count_if((p == 0) & (lab == 0)).alias("tp"),
        F.count_if((p == 0) & (lab == 1)).alias("fp"),
        F.count_if((p == 1) & (lab == 0)).alias("fn"),
        F.count_if((p == 1) & (lab == 1)).alias("tn"),
    )


def threshold_metrics(conf: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy, precision, recall, F1 rounded to 4 digits; 0/0 -> NULL."""
    keys = list(keys)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    x = conf.select(
        *keys,
        "threshold",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
    )
    f1 = F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return x.select(
        *keys,
        "threshold",
        F.round("accuracy", 4).alias("accuracy"),
        F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
    )


def auprc(pred: DataFrame, keys: Sequence[str] = KEYS, positive: int = 1, buckets: int | None = None) -> DataFrame:
    """Area under the precision-recall curve, Davis-Goadrich interpolation, exact integral.

    Walk distinct scores from high to low.  Between PR points (TPa, FPa) and
    (TPb, FPb) precision along the interpolated segment is x / (a x + b) with
    h = dFP/dTP, a = 1 + h, b = FPa - h TPa, whose integral is
    x/a - (b/a^2) ln(a x + b); the sum over segments is divided by #positives.
    The curve starts at (0, 0).  Output: keys, n_pos, auprc.
    """
    keys = list(keys)
    c = collapse(pred, keys)
    fg, bg = ("pos", "neg") if positive == 1 else ("neg", "pos")
    c = c.select(*keys, (-F.col("score")).alias("nscore"), F.col(fg).alias("tpn"), F.col(bg).alias("fpn"))
    s = ordered_scan(c, keys, ["nscore"], sums=["tpn", "fpn"], buckets=buckets)
    tpb, fpb = F.col("tpn_cum").cast("double"), F.col("fpn_cum").cast("double")
    tpa, fpa = tpb - F.col("tpn"), fpb - F.col("fpn")
    h = F.try_divide(F.col("fpn"), F.col("tpn"))
    a = F.lit(1.0) + h
    b = fpa - h * tpa
    seg = (tpb - tpa) / a - F.when(b == 0, F.lit(0.0)).otherwise((b / (a * a)) * (F.log(a * tpb + b) - F.log(a * tpa + b)))
    area = F.when(F.col("tpn") > 0, seg).otherwise(F.lit(0.0))
    g = s.groupBy(*keys).agg(F.sum(area).alias("area"), F.sum("tpn").alias("n_pos"))
    return g.select(*keys, "n_pos", F.try_divide(F.col("area"), F.col("n_pos")).alias("auprc"))


def roc_interp(roc: DataFrame, keys: Sequence[str] = KEYS, n: int = 150, buckets: int | None = None) -> DataFrame:
    """Sensitivity at ``n`` evenly spaced specificities in [0, 1].

    Linear interpolation between neighbouring curve points; on an exact hit
    of a specificity shared by several points the highest sensitivity wins.
    The curve is thinned to the first and last points between grid rows; these
    and the grid rows are merged into one ordered stream and the neighbours are found by the ordered scan (an as-of lookup both ways), so
    there is no range join and no pairing of grid rows with curve points.
    Output: keys, j, specificity, sensitivity.
    """
    keys = list(keys)
    spec, sens, step = F.col("specificity"), F.col("sensitivity"), F.lit(float(n - 1))
    # between two grid rows only the first and the last specificity can be a neighbour: map-side aggregates leave 2 n points a group
    up = F.ceil(spec * step)
    cell = up + F.when(up / step < spec, 1).when((up - 1) / step >= spec, -1).otherwise(0)  # the first grid row that is not below
    low, high = F.struct(spec.alias("spec"), sens.alias("s")), F.struct(spec.alias("spec"), (-sens).alias("s"))
    ends = (
        roc.where(sens.isNotNull() & spec.isNotNull())
        .groupBy(*keys, cell.alias("cell"))
        .agg(F.min(low).alias("a"), F.min(high).alias("b"), F.max(high).alias("c"), F.max(low).alias("d"))
    )
    first = F.struct(F.col("a.spec").alias("spec"), F.col("a.s").alias("smin"), (-F.col("b.s")).alias("smax"))
    last = F.struct(F.col("d.spec").alias("spec"), (-F.col("c.s")).alias("smin"), F.col("d.s").alias("smax"))
    pts = ends.select(*keys, F.explode(F.array_distinct(F.array(first, last))).alias("p")).select(*keys, "p.*")
    curve = pts.select(
        *keys,
        "spec",
        F.lit(0).alias("kind"),
        F.lit(None).cast("int").alias("j"),
        F.struct("spec", "smin", "smax").alias("pt"),
    )
    grid = (
        pts.select(*keys)
        .distinct()
        .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
        .select(
            *keys,
            (F.col("j") / F.lit(float(n - 1))).alias("spec"),
            F.lit(1).alias("kind"),
            "j",
            F.lit(None).cast("struct<spec:double,smin:double,smax:double>").alias("pt"),
        )
    )
    s = ordered_scan(curve.unionByName(grid), keys, ["spec", "kind"], fwd=["pt"], bwd=["pt"], buckets=buckets)
    s = s.where(F.col("kind") == 1)
    prev, nxt = F.col("pt_prev"), F.col("pt_next")
    interp = prev["smin"] + (F.col("spec") - prev["spec"]) * (nxt["smax"] - prev["smin"]) / (nxt["spec"] - prev["spec"])
    value = (
        F.when(prev.isNotNull() & (prev["spec"] == F.col("spec")), prev["smax"])
        .when(prev.isNull(), nxt["smax"])
        .when(nxt.isNull(), prev["smin"])
        .otherwise(interp)
    )
    return s.select(*keys, "j", F.col("spec").alias("specificity"), value.alias("sensitivity"))
