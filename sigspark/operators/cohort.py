"""Cohort filters, set operations and cohort-level aggregates.

Long tables: clinical ``(study, patientid, response)``, scores
``(study, patientid, signature, score)``, expression
``(study, patientid, gene, value)``.  Every filter that depends on a group
property (cohort size, completeness, coverage) is a grouped aggregate
(map-side partial) joined back on the group key - never a window over a
whole study.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(clin: DataFrame, id_col: str = "patientid", label: str = "response") -> DataFrame:
    """Complete cases of (id, label)."""
    return clin.dropna(subset=[id_col, label])


def min_cohort(clin: DataFrame, n: int = 25, key: str = "study") -> DataFrame:
    """Keep studies with at least ``n`` labelled rows (``>= n``, as the code does)."""
    lab = labelled(clin)
    big = lab.groupBy(key).count().where(F.col("count") >= n).select(key)
    return lab.join(big, key, "left_semi")


def restrict(df: DataFrame, names: DataFrame, col: str = "signature") -> DataFrame:
    """Set membership of ``col`` in a one-column name table (left semi join)."""
    return df.join(names.select(F.col(names.columns[0]).alias(col)), col, "left_semi")


def names_frame(spark, names: Sequence[str], col: str = "signature") -> DataFrame:
    """A name list as a one-column table with its position (``pos``, 0-based)."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{col} string, pos int")


def restrict_samples(expr: DataFrame, clin: DataFrame, keys: Sequence[str] = ("study", "patientid")) -> DataFrame:
    """Keep samples that have a label in the same study (left semi join on the keys)."""
    return expr.join(labelled(clin).select(*keys), list(keys), "left_semi")


def complete_signatures(scores: DataFrame) -> DataFrame:
    """Drop a signature from a study when any of its scores there is NULL."""
    from ..session import reuse

    scores = reuse(scores)  # read by the completeness aggregate and by the semi join
    ok = (
        scores.groupBy("study", "signature")
        .agg(F.bool_and(F.col("score").isNotNull()).alias("ok"))
        .where("ok")
        .select("study", "signature")
    )
    return scores.join(ok, ["study", "signature"], "left_semi")


def gene_filter(expr: DataFrame, missing_perc: float = 0.5, floor: float = 0.001, log_floor: bool = False) -> DataFrame:
    """Drop a gene from a study when more than ``missing_perc`` of its samples sit at the floor.

    ``floor`` is the value floor; ``log_floor=True`` takes log2(floor) as the
    floor (log-expression input with a constant offset ``const.int``).
    """
    fl = F.log2(F.lit(floor)) if log_floor else F.lit(floor)
    keep = (
        expr.groupBy("study", "gene")
        .agg(F.avg(F.when(F.col("value") <= fl, 1.0).otherwise(0.0)).alias("at_floor"))
        .where(F.col("at_floor") <= missing_perc)
        .select("study", "gene")
    )
    return expr.join(keep, ["study", "gene"], "left_semi")


def coverage(expr: DataFrame, sigs: DataFrame, n_cutoff: int = 15, sig_perc: float | None = 0.8) -> DataFrame:
    """Per (study, signature): samples, signature genes, genes present, and the gate.

    The gate passes when the study has at least ``n_cutoff`` samples and more
    than ``sig_perc`` of the signature's genes are measured in the study
    (``sig_perc=None`` skips the gene rule).  Joins are on ``gene`` (genes
    per study, one row each) and ``study`` (one row per study).
    """
    samples = expr.groupBy("study").agg(F.countDistinct("patientid").alias("n_samples"))
    genes = expr.select("study", "gene").distinct()
    sig_genes = sigs.select("signature", "gene").distinct()
    n_sig = sig_genes.groupBy("signature").agg(F.count(F.lit(1)).alias("n_genes"))
    present = genes.join(sig_genes, "gene").groupBy("study", "signature").agg(F.count(F.lit(1)).alias("n_present"))
    # pairs with no gene present have no row: such a signature cannot be scored in that study.
    cov = present.join(n_sig, "signature").join(samples, "study")
    gate = F.col("n_samples") >= n_cutoff
    if sig_perc is not None:
        gate = gate & (F.col("n_present") / F.col("n_genes") > sig_perc)
    return cov.select("study", "signature", "n_samples", "n_genes", "n_present", gate.alias("pass"))


def common_features(scores: DataFrame) -> DataFrame:
    """Signatures present (non-null) in every study: relational division by count.

    The number of studies is a scalar subquery, evaluated once.
    """
    present = scores.where(F.col("score").isNotNull()).select("study", "signature").distinct()
    n_studies = scores.select(F.countDistinct("study")).scalar()
    per = present.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    return per.where(F.col("n") == n_studies).select("signature")


def schema_agreement(scores: DataFrame) -> DataFrame:
    """Does every study carry the same feature set?  One row: studies, distinct sets, agree."""
    sets = scores.groupBy("study").agg(F.sort_array(F.collect_set("signature")).alias("fs"))
    return sets.agg(
        F.count(F.lit(1)).alias("n_studies"),
        F.countDistinct("fs").alias("n_feature_sets"),
    ).select("n_studies", "n_feature_sets", (F.col("n_feature_sets") == 1).alias("agree"))


def pool(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns absent from a part come out NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def cohort_summary(scores: DataFrame, clin: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per study: samples with both scores and a label, selected signatures present, missing.

    Studies come from the score table (left side), so a study with no
    selected signature still shows with 0 present.
    """
    sel = F.array(*[F.lit(n) for n in names])
    lab = labelled(clin).select("study", "patientid").distinct()
    both = scores.select("study", "patientid").distinct().join(lab, ["study", "patientid"])
    n = both.groupBy("study").agg(F.count(F.lit(1)).alias("sample_size"))
    present = scores.groupBy("study").agg(
        F.size(
            F.array_intersect(F.collect_set(F.when(F.col("score").isNotNull(), F.col("signature"))), sel)
        ).alias("num_selected_signature")
    )
    return present.join(n, "study", "left").select(
        "study",
        F.coalesce(F.col("sample_size"), F.lit(0)).cast("bigint").alias("sample_size"),
        F.col("num_selected_signature").cast("bigint").alias("num_selected_signature"),
        (F.lit(len(names)) - F.col("num_selected_signature")).cast("bigint").alias("num_missing_signature"),
    )

