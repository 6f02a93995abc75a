"""Query keys over fitted tree tables: scoring, federation, summaries, importance, documents, reports."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import sigmoid
from ..operators import boost as B
from ..operators import roc
from ..operators import trees as TR
from ..session import scratch_path
from . import boost_sql as BS
from .q_boost import _AUC_OF_PREDS, _R6, _TREES_SQL_OUT, MAX_BINS, ONE_ROUND, TEST_GRID, grid_aucs, rounded_trees
from .q_roc import _AUPRC, _CONF
from .registry import query, rounded
from .views import v_wide, with_views


def _trees(spark, sf, grid=ONE_ROUND):
    return B.fit_boosted(v_wide(spark, sf), grid, MAX_BINS)


def _sql(body: str, grid=ONE_ROUND, extra: str = "") -> str:
    ctes = ",\n".join(BS.fit_ctes(grid, MAX_BINS))
    if extra:
        ctes += ",\n" + extra
    return with_views(body, "v_wide", extra=ctes)


def _score_sql(depth: int) -> str:
    parts = [
        """sc0 AS (SELECT t.model, t.tree, w.study, w.row_id, w.features, CAST(0 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS leaf
  FROM v_wide w CROSS JOIN (SELECT DISTINCT model, tree FROM trees) t)"""
    ]
    for k in range(depth + 1):
        parts.append(
            f"""sc{k + 1} AS (SELECT s.model, s.tree, s.study, s.row_id, s.features,
    CASE WHEN s.leaf IS NULL AND n.feature IS NOT NULL THEN
      CASE WHEN (CASE WHEN s.features[n.feature + 1] IS NULL THEN n.default_left ELSE s.features[n.feature + 1] < n.threshold END)
           THEN n."left" ELSE n."right" END END AS node,
    coalesce(s.leaf, CASE WHEN n.feature IS NULL THEN n.leaf_value END) AS leaf
  FROM sc{k} s LEFT JOIN trees n ON n.model = s.model AND n.tree = s.tree AND n.node = s.node)"""
        )
    parts.append(
        f"""scored AS (SELECT study, row_id, model, round(sum(leaf), 6) AS margin, round(1 / (1 + exp(-sum(leaf))), 6) AS prob
  FROM sc{depth + 1} GROUP BY study, row_id, model)"""
    )
    return ",\n".join(parts)


_DEPTH = max(ONE_ROUND["max_depth"])


@query("score_models", _sql("SELECT * FROM scored", extra=_score_sql(_DEPTH)))
def q_score_models(spark, sf):
    trees, _, _ = _trees(spark, sf)
    return rounded(TR.score_models(trees, v_wide(spark, sf)), 6, "margin", "prob")


@query("score_from_documents", _sql("SELECT * FROM scored", extra=_score_sql(_DEPTH)))
def q_score_from_documents(spark, sf):
    """Trained, written as documents, read again and scored: equal to ``score_models``."""
    trees, _, _ = _trees(spark, sf)
    path = scratch_path(spark, f"score_json_{os.path.basename(sf.rstrip('/'))}")
    TR.write_models(TR.model_to_json(trees), path)
    return rounded(TR.score_models(TR.read_models(spark, path), v_wide(spark, sf)), 6, "margin", "prob")


_MERGE = """mm AS (SELECT model, count(DISTINCT tree) AS n_trees FROM trees GROUP BY model),
moff AS (SELECT model, coalesce(sum(n_trees) OVER (ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM mm),
merged AS (SELECT 'global' AS model, CAST(o."offset" + t.tree AS INTEGER) AS tree, t.model AS source_model, t.tree AS source_tree,
    t.node, t.depth, t.feature, round(t.threshold, 6) + 0.0 AS threshold, t.default_left, t."left", t."right",
    round(t.leaf_value, 6) + 0.0 AS leaf_value, round(t.gain, 6) + 0.0 AS gain, round(t.cover, 6) + 0.0 AS cover, 0 AS tree_info
  FROM trees t JOIN moff o USING (model))"""


@query("merge_models", _sql("SELECT * FROM merged", grid=TEST_GRID, extra=_MERGE))
def q_merge_models(spark, sf):
    trees, _, _ = _trees(spark, sf, TEST_GRID)
    m = TR.merge_models(trees)
    return m.select(
        "model", "tree", "source_model", "source_tree", "node", "depth", "feature", _R6("threshold"),
        "default_left", "left", "right", _R6("leaf_value"), _R6("gain"), _R6("cover"), "tree_info",
    )


@query(
    "model_summary",
    _sql(
        """SELECT t.model, count(DISTINCT t.tree) AS num_trees, count(*) AS num_nodes, count_if(t.feature IS NULL) AS num_leaves,
       max(t.depth) AS max_depth, count(DISTINCT t.feature) AS num_features_used, 1 AS num_parallel_tree,
       any_value(f.eta) AS eta, any_value(f.colsample_bytree) AS colsample_bytree, any_value(f.subsample) AS subsample,
       any_value(f.max_depth) AS max_depth_param, CAST(1.0 AS DOUBLE) AS lambda, CAST(0.0 AS DOUBLE) AS alpha,
       'binary:logistic' AS objective
FROM trees t LEFT JOIN fits f ON f.fit_id = t.model GROUP BY t.model""",
        grid=TEST_GRID,
    ),
)
def q_model_summary(spark, sf):
    trees, _, fits = _trees(spark, sf, TEST_GRID)
    return TR.model_summary(trees, fits)


@query(
    "feature_importance",
    _sql(
        """SELECT p.model, p.feature, round(g / gt, 6) AS gain, round(c / ct, 6) AS cover, round(f / ft, 6) AS frequency
FROM (SELECT model, feature, sum(gain) AS g, sum(cover) AS c, count(*) AS f FROM trees WHERE feature IS NOT NULL GROUP BY ALL) p
JOIN (SELECT model, sum(gain) AS gt, sum(cover) AS ct, count(*) AS ft FROM trees WHERE feature IS NOT NULL GROUP BY model) t
USING (model)""",
        grid=TEST_GRID,
    ),
)
def q_feature_importance(spark, sf):
    trees, _, _ = _trees(spark, sf, TEST_GRID)
    return rounded(TR.feature_importance(trees), 6, "gain", "cover", "frequency")


@query(
    "model_to_json",
    _sql(
        """SELECT model, CAST(count(DISTINCT tree) AS INTEGER) AS num_trees, CAST(sum(CASE WHEN feature IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS leaves,
       round(sum(CASE WHEN feature IS NULL THEN leaf_value ELSE threshold END), 5) AS conditions, round(sum(coalesce(gain, 0)), 5) AS loss_changes,
       round(sum(cover), 5) AS sum_hessian, CAST(sum(feature) AS BIGINT) AS split_indices, CAST(count_if(default_left) AS BIGINT) AS default_left
FROM trees GROUP BY model""",
        grid=TEST_GRID,
    ),
)
def q_model_to_json(spark, sf):
    trees, _, _ = _trees(spark, sf, TEST_GRID)
    docs = TR.model_to_json(trees)
    each = F.from_json("json", TR.DOC_SCHEMA)["learner"]["gradient_booster"]["model"]
    t = docs.select("model", "num_trees", F.explode(each["trees"]).alias("t"))
    add = lambda c: F.aggregate(f"t.{c}", F.lit(0.0), lambda a, x: a + x)
    return t.groupBy("model", "num_trees").agg(
        F.sum(F.size(F.filter("t.left_children", lambda x: x == -1))).cast("long").alias("leaves"),
        F.round(F.sum(add("split_conditions")), 5).alias("conditions"),
        F.round(F.sum(add("loss_changes")), 5).alias("loss_changes"),
        F.round(F.sum(add("sum_hessian")), 5).alias("sum_hessian"),
        F.sum(add("split_indices")).cast("long").alias("split_indices"),
        F.sum(add("default_left")).cast("long").alias("default_left"),
    )


@query(
    "model_scan",
    _sql(
        """SELECT r.model, r.tree, r.idx AS node, r.feature, round(r.threshold, 6) + 0.0 AS threshold, r.default_left,
       l.idx AS "left", rr.idx AS "right", round(r.leaf_value, 6) + 0.0 AS leaf_value, round(r.gain, 6) + 0.0 AS gain,
       round(r.cover, 6) + 0.0 AS cover
FROM rn r LEFT JOIN rn l ON l.model = r.model AND l.tree = r.tree AND l.node = r."left"
LEFT JOIN rn rr ON rr.model = r.model AND rr.tree = r.tree AND rr.node = r."right\"""",
        grid=TEST_GRID,
        extra="rn AS (SELECT t.*, CAST(row_number() OVER (PARTITION BY model, tree ORDER BY node) - 1 AS INTEGER) AS idx FROM trees t)",
    ),
)
def q_model_scan(spark, sf):
    trees, _, _ = _trees(spark, sf, TEST_GRID)
    path = scratch_path(spark, f"models_json_{os.path.basename(sf.rstrip('/'))}")
    TR.write_models(TR.model_to_json(trees), path)
    t = TR.read_models(spark, path)
    return t.select(
        "model", "tree", "node", "feature", _R6("threshold"), "default_left", "left", "right",
        _R6("leaf_value"), _R6("gain"), _R6("cover"),
    )


# ---- training report: best grid row per study, metrics of that fit on its training rows ----

_PB = """pb AS (SELECT pr.study, pr.grid_id AS model, pr.label, round(1 / (1 + exp(-pr.margin)), 9) AS score
  FROM pr JOIN best USING (study, grid_id))"""


def _retarget(cte: str) -> str:
    return cte.replace("FROM v_pred", "FROM pb")


_REPORT = (
    ",\n".join(BS.fit_ctes(TEST_GRID, MAX_BINS))
    + ",\n"
    + _AUC_OF_PREDS.format(nr=len(TEST_GRID["nrounds"]), rounds=TEST_GRID["nrounds"])
    + ",\n"
    + _PB
    + ",\n"
    + _retarget(_CONF)
    + ",\n"
    # the AUPRC CTE reuses the collapsed table ``c`` that the ROC CTEs above define
    + "ap AS (" + _AUPRC.split("ap AS (", 1)[1]
)


@query(
    "training_report",
    with_views(
        """SELECT b.study, b.grid_id, round(b.auc, 6) AS auroc, round(cm.threshold, 6) AS threshold,
       round((tp + tn) / NULLIF(CAST(tp + fp + fn + tn AS DOUBLE), 0), 4) AS accuracy,
       round(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 4) AS precision,
       round(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 4) AS recall,
       round(2 * (tp / NULLIF(CAST(tp + fp AS DOUBLE), 0)) * (tp / NULLIF(CAST(tp + fn AS DOUBLE), 0))
             / NULLIF(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0) + tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS f1,
       round(ap.auprc, 6) AS auprc
FROM best b JOIN cm ON cm.study = b.study AND cm.model = b.grid_id JOIN ap ON ap.study = b.study AND ap.model = b.grid_id""",
        "v_wide",
        extra=_REPORT,
    ),
)
def q_training_report(spark, sf):
    rows = v_wide(spark, sf)
    _, preds, fits = B.fit_boosted(rows, TEST_GRID, MAX_BINS)
    best = B.select_best(grid_aucs(preds, fits, TEST_GRID))
    nr = TEST_GRID["nrounds"]
    pos = F.array_position(F.array(*[F.lit(int(n)) for n in nr]), F.col("nrounds"))
    p = preds.join(fits.select("fit_id", "study", "fit_no"), ["fit_id", "study"]).select(
        "study",
        ((F.col("fit_no") - 1) * len(nr) + pos).cast("int").alias("model"),
        F.col("y").cast("int").alias("label"),
        F.round(sigmoid("margin"), 9).alias("score"),
    )
    pb = p.join(best.select("study", F.col("grid_id").alias("model")), ["study", "model"], "left_semi")
    thr = roc.best_threshold(roc.roc_curve(pb))
    met = roc.threshold_metrics(roc.confusion(pb, thr))
    ap = roc.auprc(pb)
    report = (
        best.join(met.withColumnRenamed("model", "grid_id"), ["study", "grid_id"])
        .join(ap.withColumnRenamed("model", "grid_id").select("study", "grid_id", "auprc"), ["study", "grid_id"])
        .select("study", "grid_id", F.col("auc").alias("auroc"), "threshold", "accuracy", "precision", "recall", "f1", "auprc")
    )
    return rounded(report, 6, "auroc", "threshold", "auprc")


# ---- the final fit of each study with its best grid row, and its record ----

_SEARCH = ",\n".join(BS.fit_ctes(TEST_GRID, MAX_BINS)) + ",\n" + _AUC_OF_PREDS.format(nr=len(TEST_GRID["nrounds"]), rounds=TEST_GRID["nrounds"])
_REFIT = _SEARCH + ",\n" + ",\n".join(BS.refit_ctes(TEST_GRID, "best", "v_wide"))


def _refit(spark, sf):
    rows = v_wide(spark, sf)
    _, preds, fits = B.fit_boosted(rows, TEST_GRID, MAX_BINS)
    best = B.select_best(grid_aucs(preds, fits, TEST_GRID))
    return best, B.refit(rows, best, TEST_GRID, MAX_BINS)


@query(
    "refit_best",
    with_views(_TREES_SQL_OUT.replace("FROM trees", "FROM z_trees JOIN z_fits f ON f.fit_id = model WHERE tree < f.nrounds"), "v_wide", extra=_REFIT),
)
def q_refit_best(spark, sf):
    return rounded_trees(_refit(spark, sf)[1][0])


_RECORD = ",\n".join(
    [
        _REFIT,
        """pb AS (SELECT p.study, f.grid_id AS model, CAST(p.y AS INTEGER) AS label, round(1 / (1 + exp(-p.margin)), 9) AS score
  FROM z_preds p JOIN z_fits f ON f.fit_id = p.fit_id WHERE p.nrounds = f.nrounds)""",
        _retarget(_CONF),
        "ap AS (" + _AUPRC.split("ap AS (", 1)[1],
    ]
)
_PARAMS = ("nrounds", "eta", "max_depth", "gamma", "colsample_bytree", "subsample")


@query(
    "training_record",
    with_views(
        f"""SELECT b.study, b.grid_id, {", ".join(f"f.{c}" for c in _PARAMS)}, round(b.auc, 4) AS auroc, round(cm.threshold, 4) AS threshold,
       round((tp + tn) / NULLIF(CAST(tp + fp + fn + tn AS DOUBLE), 0), 4) AS accuracy,
       round(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 4) AS precision,
       round(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 4) AS recall,
       round(2 * (tp / NULLIF(CAST(tp + fp AS DOUBLE), 0)) * (tp / NULLIF(CAST(tp + fn AS DOUBLE), 0))
             / NULLIF(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0) + tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS f1,
       round(ap.auprc, 4) AS auprc
FROM best b JOIN z_fits f ON f.study = b.study JOIN cm ON cm.study = b.study AND cm.model = b.grid_id JOIN ap ON ap.study = b.study AND ap.model = b.grid_id""",
        "v_wide",
        extra=_RECORD,
    ),
)
def q_training_record(spark, sf):
    """The reference's record of a study: best parameters, AUC of the search, and the metrics of the final fit."""
    best, (_, preds, fits) = _refit(spark, sf)
    pb = preds.join(fits.select("fit_id", F.col("grid_id").alias("model")), "fit_id").select(
        "study", "model", F.col("y").cast("int").alias("label"), F.round(sigmoid("margin"), 9).alias("score")
    )
    met = roc.threshold_metrics(roc.confusion(pb, roc.best_threshold(roc.roc_curve(pb)))).withColumnRenamed("model", "grid_id")
    ap = roc.auprc(pb).select("study", F.col("model").alias("grid_id"), "auprc")
    params = fits.select("study", "grid_id", F.element_at("rounds", 1).alias("nrounds"), *_PARAMS[1:])
    out = best.join(params, ["study", "grid_id"]).join(met, ["study", "grid_id"]).join(ap, ["study", "grid_id"])
    out = out.select("study", "grid_id", *_PARAMS, F.col("auc").alias("auroc"), "threshold", "accuracy", "precision", "recall", "f1", "auprc")
    return rounded(out, 4, "auroc", "threshold", "auprc")
