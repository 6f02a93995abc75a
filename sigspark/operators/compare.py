"""Model comparison: curve bands, AUC spread, bootstrap CIs, CV folds, logistic baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def curve_band(interp: DataFrame, keys: Sequence[str] = ("study",)) -> DataFrame:
    """Mean and sample sd of interpolated sensitivity over models at each grid point.

    upper = min(mean + sd, 1), lower = max(mean - sd, 0); NULLs are skipped.
    Output: keys, j, specificity, sensitivity, sens_upper, sens_lower, n_models.
    """
    keys = list(keys)
    g = interp.groupBy(*keys, "j").agg(
        F.first("specificity").alias("specificity"),
        F.avg("sensitivity").alias("m"),
        F.stddev_samp("sensitivity").alias("sd"),
        F.count("sensitivity").alias("n_models"),
    )
    m, sd = F.col("m"), F.col("sd")
    return g.select(
        *keys,
        "j",
        "specificity",
        m.alias("sensitivity"),
        F.least(m + sd, F.lit(1.0)).alias("sens_upper"),
        F.greatest(m - sd, F.lit(0.0)).alias("sens_lower"),
        "n_models",
    )


def auc_spread(aucs: DataFrame, keys: Sequence[str] = ("study",)) -> DataFrame:
    """Mean AUC over models and its 2.5 % / 97.5 % quantiles (linear interpolation).

    ``percentile`` is exact; its buffer per group holds one value per model,
    which is bounded by the number of models, not by the data.
    """
    keys = list(keys)
    return aucs.groupBy(*keys).agg(
        F.count("auc").alias("n_models"),
        F.avg("auc").alias("auc_mean"),
        F.percentile("auc", F.lit(0.025)).alias("auc_q025"),
        F.percentile("auc", F.lit(0.975)).alias("auc_q975"),
    )


def index_within(df: DataFrame, keys: Sequence[str], order, buckets: int | None = None) -> DataFrame:
    """0-based position of each row inside its group by ``order`` (a column or list), skew-safe.

    Rows equal on every order column get distinct but arbitrary positions,
    so ``order`` should identify a row or rows equal on it must be
    interchangeable."""
    from .scan import ordered_scan

    order = [order] if isinstance(order, str) else list(order)
    s = ordered_scan(df.withColumn("_one", F.lit(1)), list(keys), order, sums=["_one"], buckets=buckets)
    return s.withColumn("idx", F.col("_one_cum") - 1).drop("_one", "_one_cum")


def compare_models(aucs: DataFrame, ci: DataFrame, spread: DataFrame, keys: Sequence[str] = ("study",)) -> DataFrame:
    """One row per (study, family): AUC, CI and the label text ``"<name> AUC: x.xx [lo-hi]"``.

    ``aucs``/``ci`` give one family per model (AUC and bootstrap CI); ``spread``
    adds the "Local mean" family (mean AUC over models and its 2.5/97.5 %
    quantiles).  Numbers in labels are rounded to 2 digits first.
    """
    keys = list(keys)
    per = aucs.join(ci, [*keys, "model"]).select(
        *keys, F.col("model").alias("family"), "auc", F.col("auc_lo").alias("ci_lo"), F.col("auc_hi").alias("ci_hi")
    )
    loc = spread.select(
        *keys, F.lit("Local mean").alias("family"), F.col("auc_mean").alias("auc"),
        F.col("auc_q025").alias("ci_lo"), F.col("auc_q975").alias("ci_hi"),
    )
    out = per.unionByName(loc)
    lab = F.format_string(
        "%s AUC: %.2f [%.2f-%.2f]", F.col("family"), F.round("auc", 2), F.round("ci_lo", 2), F.round("ci_hi", 2)
    )
    return out.withColumn("label", lab)


def stratified_folds(rows: DataFrame, k: int = 5, label: str = "y", id_col: str = "row_id", seed: int = 135) -> DataFrame:
    """Fold = (position within class by an md5 draw) mod k, so folds are balanced within class.

    The position comes from the skew-safe scan: a class is split into
    buckets, never gathered into one task.
    """
    from ..functions import md5_uniform

    r = rows.withColumn("_u", md5_uniform(F.lit(seed), F.col(id_col)))
    # the row travels through the scan; rows that share an id (of several studies) are told apart by all their sortable columns
    rest = [c for c, t in rows.dtypes if c != id_col and not t.startswith("map")]
    ix = index_within(r, [label], ["_u", id_col, *rest])
    return ix.withColumn("fold", (F.col("idx") % k).cast("int")).drop("_u", "idx")


def logit_irls(rows: DataFrame, x: str = "x", y: str = "y", key: str = "study", steps: int = 3) -> DataFrame:
    """Univariate logistic regression y ~ x per group by ``steps`` Newton (IRLS) steps from 0.

    Each step is one grouped aggregate of five moments
    (sum w, sum w x, sum w x^2, sum (y-p), sum (y-p) x) joined back on the
    group key; the 2x2 system is solved in closed form.
    Output: key, n, b0, b1.
    """
    d = rows.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    coef = d.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, "n", F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"))
    for _ in range(steps):
        j = d.join(coef, key)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("b0") + F.col("b1") * F.col("x"))))
        j = j.withColumn("p", p).withColumn("w", F.col("p") * (F.lit(1.0) - F.col("p")))
        m = j.groupBy(key, "n", "b0", "b1").agg(
            F.sum("w").alias("a"), F.sum(F.col("w") * F.col("x")).alias("b"),
            F.sum(F.col("w") * F.col("x") * F.col("x")).alias("c"),
            F.sum(F.col("y") - F.col("p")).alias("g0"), F.sum((F.col("y") - F.col("p")) * F.col("x")).alias("g1"),
        )
        det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
        coef = m.select(
            key, "n",
            (F.col("b0") + F.try_divide(F.col("c") * F.col("g0") - F.col("b") * F.col("g1"), det)).alias("b0"),
            (F.col("b1") + F.try_divide(F.col("a") * F.col("g1") - F.col("b") * F.col("g0"), det)).alias("b1"),
        )
    return coef.select(key, "n", "b0", "b1")
