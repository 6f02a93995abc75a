"""Long <-> wide reshaping, feature selection and zero-fill.

Canonical form is long ``(study, patientid, signature, score)``; the wide
form (one column per signature, names may hold ``-``/``+``/parentheses) is
only made at the edge.  Pivots always get their value list, so Spark does
not run an extra job to discover it, and the pivot is one grouped
aggregate with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bq

IDS = ("study", "patientid")


def to_wide(scores: DataFrame, names: Sequence[str], ids: Sequence[str] = IDS) -> DataFrame:
    """One row per sample, one column per signature in ``names`` order."""
    return scores.groupBy(*ids).pivot("signature", list(names)).agg(F.first("score"))


def to_long(wide: DataFrame, names: Sequence[str], ids: Sequence[str] = IDS) -> DataFrame:
    """Inverse of :func:`to_wide` (NULL cells stay as NULL scores)."""
    return wide.unpivot(list(ids), [F.col(bq(n)) for n in names], "signature", "score")


def select_features(wide: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project ``names`` in the given order; every name must exist."""
    missing = [n for n in names if n not in wide.columns]
    if missing:
        raise ValueError(f"features not in the table: {missing}")
    return wide.select(*[F.col(bq(c)) for c in keep], *[F.col(bq(n)) for n in names])


def to_matrix(wide: DataFrame, names: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Features as ``array<double>`` in ``names`` order plus the label column."""
    feats = F.array(*[F.col(bq(n)).cast("double") for n in names]).alias("features")
    return wide.select(*[F.col(bq(c)) for c in keep], feats, F.col(bq(label)))


def missing_features(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per study, the names of ``names`` with no score row in that study.

    Set difference per study as ``array_except`` of the fixed list and the
    study's (bounded) set of signatures, then ``explode``: no product of
    studies and names is formed.
    """
    sel = F.array(*[F.lit(n) for n in names])
    present = scores.groupBy("study").agg(F.collect_set("signature").alias("have"))
    return present.select("study", F.explode(F.array_except(sel, F.col("have"))).alias("signature"))


def zero_fill(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Restrict to ``names`` and add 0.0 scores for names absent from a whole study.

    A name present in a study keeps its own NULLs.  Each sample is joined to
    its study's missing-name array (one row per study) and the array is
    exploded, so the output is built in proportion to its own size.
    """
    sel = F.array(*[F.lit(n) for n in names])
    kept = scores.where(F.col("signature").isin(*names)).select("study", "patientid", "signature", "score")
    miss = (
        scores.groupBy("study")
        .agg(F.collect_set("signature").alias("have"))
        .select("study", F.array_except(sel, F.col("have")).alias("miss"))
        .where(F.size("miss") > 0)
    )
    samples = scores.select("study", "patientid").distinct()
    filled = samples.join(miss, "study").select(
        "study", "patientid", F.explode("miss").alias("signature"), F.lit(0.0).alias("score")
    )
    return kept.unionByName(filled)


def join_labels(wide: DataFrame, clin: DataFrame, keys: Sequence[str] = IDS) -> DataFrame:
    """Inner equi-join of scores and labels on (study, patientid)."""
    return wide.join(clin.dropna(subset=["response"]).select(*keys, "response"), list(keys), "inner")
