"""ROC query keys on ``v_pred`` (two score columns of lineitem as two models)."""

from __future__ import annotations

from ..operators import roc
from .registry import query, rounded
from .views import v_pred, with_views

_C = """c AS (
  SELECT study, model, CAST(score AS DOUBLE) AS score,
         CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg
  FROM v_pred WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY study, model, score),
t AS (SELECT study, model, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c GROUP BY study, model)"""

_W = "PARTITION BY study, model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

_ROC = (
    _C
    + f""",
s AS (SELECT c.*, t.n_pos, t.n_neg, sum(pos) OVER w AS pos_cum, sum(neg) OVER w AS neg_cum,
             row_number() OVER w AS rn, lead(score) OVER w AS score_next
      FROM c JOIN t USING (study, model) WINDOW w AS ({_W})),
r AS (
  SELECT study, model, rn + 1 AS ord,
         CASE WHEN score_next IS NULL THEN 'inf'::DOUBLE ELSE (score + score_next) / 2 END AS threshold,
         (n_pos - pos_cum) / NULLIF(n_pos, 0)::DOUBLE AS sensitivity,
         neg_cum / NULLIF(n_neg, 0)::DOUBLE AS specificity,
         (n_pos - pos_cum)::HUGEINT * n_neg + neg_cum::HUGEINT * n_pos AS ynum
  FROM s
  UNION ALL
  SELECT study, model, 1, '-inf'::DOUBLE,
         CASE WHEN n_pos > 0 THEN 1.0::DOUBLE END, CASE WHEN n_neg > 0 THEN 0.0::DOUBLE END,
         n_pos::HUGEINT * n_neg
  FROM t)"""
)

_BEST = (
    _ROC
    + """,
jt AS (SELECT study, model, ynum, max(sensitivity + specificity) AS youden, sum(threshold) AS t_sum, count(*) AS n_tied
       FROM r WHERE threshold NOT IN ('inf'::DOUBLE, '-inf'::DOUBLE) AND sensitivity IS NOT NULL
       GROUP BY study, model, ynum),
bt AS (SELECT study, model, arg_max(t_sum / n_tied, ynum) AS threshold, arg_max(youden, ynum) AS youden,
              arg_max(n_tied, ynum) AS n_tied FROM jt GROUP BY study, model)"""
)

_INTERP = (
    _ROC
    + """,
pts AS (SELECT study, model, specificity AS spec, min(sensitivity) AS smin, max(sensitivity) AS smax
        FROM r WHERE sensitivity IS NOT NULL AND specificity IS NOT NULL GROUP BY study, model, specificity),
u AS (SELECT study, model, spec, 0 AS kind, CAST(NULL AS INTEGER) AS j, spec AS pspec, smin, smax FROM pts
      UNION ALL
      SELECT g.study, g.model, CAST(t.j AS DOUBLE) / 149, 1, CAST(t.j AS INTEGER), NULL, NULL, NULL
      FROM (SELECT DISTINCT study, model FROM pts) g CROSS JOIN range(0, 150) t(j)),
ri AS (
SELECT study, model, j, spec AS specificity,
       CASE WHEN p_spec IS NOT NULL AND p_spec = spec THEN p_smax
                  WHEN p_spec IS NULL THEN n_smax
                  WHEN n_spec IS NULL THEN p_smin
                  ELSE p_smin + (spec - p_spec) * (n_smax - p_smin) / (n_spec - p_spec) END AS sensitivity
FROM (SELECT *, last_value(pspec IGNORE NULLS) OVER wf AS p_spec, last_value(smin IGNORE NULLS) OVER wf AS p_smin,
             last_value(smax IGNORE NULLS) OVER wf AS p_smax,
             first_value(pspec IGNORE NULLS) OVER wb AS n_spec, first_value(smax IGNORE NULLS) OVER wb AS n_smax
      FROM u
      WINDOW wf AS (PARTITION BY study, model ORDER BY spec, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             wb AS (PARTITION BY study, model ORDER BY spec, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
WHERE kind = 1)"""
)

_AUC = (
    _C
    + f""",
a AS (SELECT study, model, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       sum(pos * ((neg_cum - neg) + CAST(neg AS DOUBLE) * 0.5)) / NULLIF(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
FROM (SELECT c.*, sum(neg) OVER ({_W}) AS neg_cum FROM c) GROUP BY study, model)"""
)

_AUPRC = (
    _C
    + """,
ap AS ("""
    + """SELECT study, model, CAST(sum(tpn) AS BIGINT) AS n_pos,
       sum(CASE WHEN tpn > 0 THEN (tpb - tpa) / (1 + h)
                      - CASE WHEN fpa - h * tpa = 0 THEN 0
                             ELSE ((fpa - h * tpa) / ((1 + h) * (1 + h)))
                                  * (ln((1 + h) * tpb + fpa - h * tpa) - ln((1 + h) * tpa + fpa - h * tpa)) END
                 ELSE 0 END) / NULLIF(sum(tpn), 0) AS auprc
FROM (SELECT study, model, tpn, CAST(tpb AS DOUBLE) AS tpb, CAST(tpb - tpn AS DOUBLE) AS tpa,
             CAST(fpb - fpn AS DOUBLE) AS fpa, CAST(fpn AS DOUBLE) / NULLIF(tpn, 0) AS h
      FROM (SELECT study, model, pos AS tpn, neg AS fpn,
                   sum(pos) OVER w AS tpb, sum(neg) OVER w AS fpb
            FROM c WINDOW w AS (PARTITION BY study, model ORDER BY -score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
GROUP BY study, model"""
    + """)"""
)

_CONF = (
    _BEST
    + """,
cm AS (SELECT p.study, p.model, bt.threshold,
              count_if(p.score < bt.threshold AND p.label = 0) AS tp,
              count_if(p.score < bt.threshold AND p.label = 1) AS fp,
              count_if(p.score >= bt.threshold AND p.label = 0) AS fn,
              count_if(p.score >= bt.threshold AND p.label = 1) AS tn
       FROM v_pred p JOIN bt USING (study, model)
       WHERE p.label IS NOT NULL AND p.score IS NOT NULL GROUP BY p.study, p.model, bt.threshold)"""
)


@query("auc", with_views("SELECT study, model, n_pos, n_neg, round(auc, 6) AS auc FROM a", "v_pred", extra=_AUC))
def q_auc(spark, sf):
    return rounded(roc.auc(v_pred(spark, sf)), 6, "auc")


@query(
    "auc_auto",
    with_views(
        f"""SELECT study, model, CASE WHEN med_ctrl > med_case THEN '>' ELSE '<' END AS direction,
       round(CASE WHEN med_ctrl > med_case THEN 1 - u / NULLIF(CAST(n_pos AS DOUBLE) * n_neg, 0)
                  ELSE u / NULLIF(CAST(n_pos AS DOUBLE) * n_neg, 0) END, 6) AS auc
FROM (SELECT study, model, sum(pos * ((neg_cum - neg) + CAST(neg AS DOUBLE) * 0.5)) AS u,
             any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg,
             (min(CASE WHEN neg_cum >= floor((n_neg - 1) / 2) + 1 THEN score END)
              + min(CASE WHEN neg_cum >= ceil((n_neg - 1) / 2) + 1 THEN score END)) / 2 AS med_ctrl,
             (min(CASE WHEN pos_cum >= floor((n_pos - 1) / 2) + 1 THEN score END)
              + min(CASE WHEN pos_cum >= ceil((n_pos - 1) / 2) + 1 THEN score END)) / 2 AS med_case
      FROM (SELECT c.*, t.n_pos, t.n_neg, sum(neg) OVER w AS neg_cum, sum(pos) OVER w AS pos_cum
            FROM c JOIN t USING (study, model) WINDOW w AS ({_W}))
      GROUP BY study, model)""",
        "v_pred",
        extra=_C,
    ),
)
def q_auc_auto(spark, sf):
    return rounded(roc.auc_auto(v_pred(spark, sf)), 6, "auc")


@query("roc_curve", with_views(
        "SELECT study, model, ord, round(threshold, 6) AS threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM r",
        "v_pred",
        extra=_ROC,
    ))
def q_roc_curve(spark, sf):
    return rounded(roc.roc_curve(v_pred(spark, sf)).drop("youden_num"), 6, "threshold", "sensitivity", "specificity")


@query("best_threshold", with_views("SELECT study, model, round(threshold, 6) AS threshold, round(youden, 6) AS youden, n_tied FROM bt", "v_pred", extra=_BEST))
def q_best_threshold(spark, sf):
    return rounded(roc.best_threshold(roc.roc_curve(v_pred(spark, sf))), 6, "threshold", "youden")


@query("confusion_matrix", with_views("SELECT * REPLACE (round(threshold, 6) AS threshold) FROM cm", "v_pred", extra=_CONF))
def q_confusion(spark, sf):
    p = v_pred(spark, sf)
    return rounded(roc.confusion(p, roc.best_threshold(roc.roc_curve(p))), 6, "threshold")


@query(
    "threshold_metrics",
    with_views(
        """SELECT study, model, round(threshold, 6) AS threshold,
       round((tp + tn) / NULLIF(CAST(tp + fp + fn + tn AS DOUBLE), 0), 4) AS accuracy,
       round(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 4) AS precision,
       round(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 4) AS recall,
       round(2 * (tp / NULLIF(CAST(tp + fp AS DOUBLE), 0)) * (tp / NULLIF(CAST(tp + fn AS DOUBLE), 0))
             / NULLIF(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0) + tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS f1
FROM cm""",
        "v_pred",
        extra=_CONF,
    ),
)
def q_threshold_metrics(spark, sf):
    p = v_pred(spark, sf)
    return rounded(roc.threshold_metrics(roc.confusion(p, roc.best_threshold(roc.roc_curve(p)))), 6, "threshold")


@query("auprc", with_views("SELECT study, model, n_pos, round(auprc, 6) AS auprc FROM ap", "v_pred", extra=_AUPRC))
def q_auprc(spark, sf):
    return rounded(roc.auprc(v_pred(spark, sf)), 6, "auprc")


@query("roc_interp", with_views(
        "SELECT study, model, j, round(specificity, 6) AS specificity, round(sensitivity, 6) AS sensitivity FROM ri", "v_pred", extra=_INTERP
    ))
def q_roc_interp(spark, sf):
    return rounded(roc.roc_interp(roc.roc_curve(v_pred(spark, sf))), 6, "specificity", "sensitivity")
