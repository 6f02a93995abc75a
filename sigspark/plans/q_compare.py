"""Query keys for model comparison (bands, spreads, bootstrap, CV, logistic baseline)."""

from __future__ import annotations

from ..operators import bootstrap, compare, logistic, roc
from ..session import reuse
from .q_roc import _AUC, _INTERP
from .registry import query, rounded
from .views import v_pred, with_views


@query(
    "curve_band",
    with_views(
        """SELECT study, j, round(specificity, 6) AS specificity, round(m, 6) AS sensitivity, round(least(m + sd, 1.0), 6) AS sens_upper,
       round(greatest(m - sd, 0.0), 6) AS sens_lower, n_models
FROM (SELECT study, j, any_value(specificity) AS specificity, avg(sensitivity) AS m,
             stddev_samp(sensitivity) AS sd, count(sensitivity) AS n_models
      FROM ri GROUP BY study, j)""",
        "v_pred",
        extra=_INTERP,
    ),
)
def q_curve_band(spark, sf):
    band = compare.curve_band(roc.roc_interp(roc.roc_curve(v_pred(spark, sf))))
    return rounded(band, 6, "specificity", "sensitivity", "sens_upper", "sens_lower")


@query(
    "auc_spread",
    with_views(
        """SELECT study, count(auc) AS n_models, round(avg(auc), 6) AS auc_mean,
       round(quantile_cont(auc, 0.025), 6) AS auc_q025, round(quantile_cont(auc, 0.975), 6) AS auc_q975
FROM a GROUP BY study""",
        "v_pred",
        extra=_AUC,
    ),
)
def q_auc_spread(spark, sf):
    return rounded(compare.auc_spread(roc.auc(v_pred(spark, sf))), 6, "auc_mean", "auc_q025", "auc_q975")


# ---- bootstrap CI, comparison table, CV and the logistic baseline ----

from pyspark.sql import functions as F  # noqa: E402

from ..operators import boost as B  # noqa: E402
from . import boost_sql as BS  # noqa: E402
from ..functions import sigmoid  # noqa: E402
from .q_boost import _TREES_SQL_OUT, MAX_BINS, TEST_GRID, rounded_trees  # noqa: E402
from .q_roc import _AUC  # noqa: E402,F811
from .views import v_wide  # noqa: E402

BOOT_REPS = 1000  # replicates, as many as the reference draws
BOOT_SEED = 42
CV_K = 5
CV_SEED = 135


def _boot_sql(src: str, reps: int = BOOT_REPS, seed: int = BOOT_SEED, cell: int = bootstrap.CELL) -> str:
    """The same draws, one row each: a class's draws over the group's cells (where it has more than one), then each cell's over its rows."""

    def base(level: int, span: str) -> str:
        key = ("study", "model", "label", str(seed), str(level), span)
        return f"{BS.md5_base_sql(*key)} AS b0, {BS.md5_base_sql(*key, part=1)} AS b1"

    k = "study, model, label"
    return f"""bi AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score) - 1 AS ci, count(*) OVER (PARTITION BY {k}) AS n,
    max(cell) OVER (PARTITION BY study, model) AS top FROM (SELECT study, model, label, CAST(score AS DOUBLE) AS score,
      (rank() OVER (PARTITION BY study, model ORDER BY CAST(score AS DOUBLE)) - 1) // {cell} AS cell
    FROM {src} WHERE label IN (0, 1) AND score IS NOT NULL)),
ix AS (SELECT *, row_number() OVER (PARTITION BY {k}, cell ORDER BY score) - 1 AS idx, count(*) OVER (PARTITION BY {k}, cell) AS m FROM bi),
rp AS (SELECT rep FROM range(1, {reps + 1}) r(rep)),
d1 AS (SELECT {k}, rep, CAST(floor(u * n) AS BIGINT) AS ci FROM ({BS.uniform_sql(f"SELECT {k}, n, ci AS j, rep, {base(1, '0')} FROM bi CROSS JOIN rp WHERE top > 0", "rep", "j")})),
n1 AS (SELECT d1.study, d1.model, d1.label, bi.cell, rep, count(*) AS cnt FROM d1 JOIN bi USING (study, model, label, ci) GROUP BY ALL
  UNION ALL SELECT DISTINCT {k}, cell, rep, n FROM bi CROSS JOIN rp WHERE top = 0),
cl AS (SELECT {k}, cell, m, {base(0, "cell")} FROM (SELECT DISTINCT {k}, cell, m FROM ix)),
d0 AS (SELECT {k}, cell, rep, idx, count(*) AS w FROM (SELECT {k}, cell, rep, CAST(floor(u * m) AS BIGINT) AS idx
  FROM ({BS.uniform_sql(f"SELECT {k}, cell, m, rep, b0, b1, unnest(range(cnt)) AS j FROM n1 JOIN cl USING ({k}, cell)", "rep", "j")})) GROUP BY ALL),
bc AS (SELECT i.study, i.model, d.rep, i.score, sum(CASE WHEN i.label = 1 THEN d.w ELSE 0 END)::BIGINT AS pos,
          sum(CASE WHEN i.label = 0 THEN d.w ELSE 0 END)::BIGINT AS neg
  FROM ix i JOIN d0 d ON d.study = i.study AND d.model = i.model AND d.label = i.label AND d.cell = i.cell AND d.idx = i.idx GROUP BY ALL),
ba AS (SELECT study, model, rep, sum(pos * ((neg_cum - neg) + CAST(neg AS DOUBLE) * 0.5))
          / NULLIF(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
  FROM (SELECT bc.*, sum(neg) OVER (PARTITION BY study, model, rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM bc)
  GROUP BY study, model, rep),
boot AS (SELECT study, model, count(auc) AS n_reps, quantile_cont(auc, 0.025) AS auc_lo,
    quantile_cont(auc, 0.5) AS auc_med, quantile_cont(auc, 0.975) AS auc_hi FROM ba GROUP BY study, model)"""


@query(
    "auc_bootstrap",
    with_views(
        "SELECT study, model, n_reps, round(auc_lo, 6) AS auc_lo, round(auc_med, 6) AS auc_med, round(auc_hi, 6) AS auc_hi FROM boot", "v_pred", extra=_boot_sql("v_pred"),
    ),
)
def q_auc_bootstrap(spark, sf):
    return rounded(bootstrap.auc_bootstrap(v_pred(spark, sf), reps=BOOT_REPS, seed=BOOT_SEED), 6, "auc_lo", "auc_med", "auc_hi")


@query(
    "compare_models",
    with_views(
        """SELECT study, family, round(auc, 6) AS auc, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi,
       printf('%s AUC: %.2f [%.2f-%.2f]', family, round(auc, 2), round(ci_lo, 2), round(ci_hi, 2)) AS label
FROM (SELECT a.study, a.model AS family, a.auc, b.auc_lo AS ci_lo, b.auc_hi AS ci_hi FROM a JOIN boot b USING (study, model)
      UNION ALL
      SELECT study, 'Local mean', avg(auc), quantile_cont(auc, 0.025), quantile_cont(auc, 0.975)
      FROM a GROUP BY study)""",
        "v_pred",
        extra=_AUC + ",\n" + _boot_sql("v_pred"),
    ),
)
def q_compare_models(spark, sf):
    p = v_pred(spark, sf)
    a = roc.auc(p)
    table = compare.compare_models(
        a.select("study", "model", "auc"), bootstrap.auc_bootstrap(p, reps=BOOT_REPS, seed=BOOT_SEED), compare.auc_spread(a)
    )
    return rounded(table, 6, "auc", "ci_lo", "ci_hi")


_FOLDS = f"""fo AS (SELECT w.*, CAST((row_number() OVER (PARTITION BY y ORDER BY {BS.u_of(str(CV_SEED), 'w.row_id')}, w.row_id) - 1) % {CV_K} AS INTEGER) AS fold
  FROM v_wide w)"""


@query("stratified_folds", with_views("SELECT study, row_id, features, y, response, fold FROM fo", "v_wide", extra=_FOLDS))
def q_stratified_folds(spark, sf):
    return compare.stratified_folds(v_wide(spark, sf), CV_K, seed=CV_SEED).select(
        "study", "row_id", "features", "y", "response", "fold"
    )


def _cv_sql() -> str:
    depth = max(TEST_GRID["max_depth"])
    nr = sorted(TEST_GRID["nrounds"])
    parts = [
        _FOLDS,
        f"""cvw AS (SELECT CAST(t.cv AS INTEGER) AS study, fo.row_id, fo.features, fo.y FROM fo CROSS JOIN range(0, {CV_K}) t(cv)
  WHERE t.cv <> fo.fold)""",
        *BS.fit_ctes(TEST_GRID, MAX_BINS, src="cvw"),
        """cs0 AS (SELECT t.model, t.tree, fo.fold AS study, fo.row_id, fo.y, fo.features, CAST(0 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS leaf
  FROM fo JOIN fits f ON f.study = fo.fold JOIN (SELECT DISTINCT model, tree FROM trees) t ON t.model = f.fit_id)""",
    ]
    for k in range(depth + 1):
        parts.append(
            f"""cs{k + 1} AS (SELECT s.model, s.tree, s.study, s.row_id, s.y, s.features,
    CASE WHEN s.leaf IS NULL AND n.feature IS NOT NULL THEN
      CASE WHEN (CASE WHEN s.features[n.feature + 1] IS NULL THEN n.default_left ELSE s.features[n.feature + 1] < n.threshold END)
           THEN n."left" ELSE n."right" END END AS node,
    coalesce(s.leaf, CASE WHEN n.feature IS NULL THEN n.leaf_value END) AS leaf
  FROM cs{k} s LEFT JOIN trees n ON n.model = s.model AND n.tree = s.tree AND n.node = s.node)"""
        )
    rounds = ", ".join(str(n) for n in TEST_GRID["nrounds"])
    margins = " UNION ALL ".join(
        f"SELECT study, row_id, y, model, {n} AS nrounds, sum(CASE WHEN tree < {n} THEN leaf END) AS margin FROM cs{depth + 1} GROUP BY study, row_id, y, model"
        for n in nr
    )
    parts += [
        f"cm_ AS ({margins})",
        f"""cp AS (SELECT m.study AS fold, CAST((f.fit_no - 1) * {len(nr)} + list_position([{rounds}], m.nrounds) AS INTEGER) AS grid_id,
    CAST(m.y AS INTEGER) AS label, round(m.margin, 9) AS score FROM cm_ m JOIN fits f ON f.fit_id = m.model)""",
        """cc AS (SELECT fold, grid_id, score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
    CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM cp GROUP BY ALL)""",
        """cva AS (SELECT fold, grid_id, sum(pos * ((neg_cum - neg) + CAST(neg AS DOUBLE) * 0.5))
    / NULLIF(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
  FROM (SELECT cc.*, sum(neg) OVER (PARTITION BY fold, grid_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM cc)
  GROUP BY fold, grid_id)""",
        "cvm AS (SELECT grid_id, count(auc) AS n_folds, avg(auc) AS mean_auc FROM cva GROUP BY grid_id)",
    ]
    return ",\n".join(parts)


@query("cv_mean_auc", with_views("SELECT grid_id, n_folds, round(mean_auc, 6) AS mean_auc FROM cvm", "v_wide", extra=_cv_sql()))
def q_cv_mean_auc(spark, sf):
    _, mean = B.cross_validate(v_wide(spark, sf), TEST_GRID, CV_K, MAX_BINS, CV_SEED)
    return rounded(mean, 6, "mean_auc")


@query(
    "cv_select",
    with_views(
        "SELECT grid_id, n_folds, round(mean_auc, 6) AS mean_auc FROM (SELECT *, row_number() OVER (ORDER BY round(mean_auc, 12) DESC NULLS LAST, grid_id) AS r FROM cvm) WHERE r = 1",
        "v_wide",
        extra=_cv_sql(),
    ),
)
def q_cv_select(spark, sf):
    _, mean = B.cross_validate(v_wide(spark, sf), TEST_GRID, CV_K, MAX_BINS, CV_SEED)
    return rounded(B.cv_select(mean), 6, "mean_auc")


_BEST_CV = "cvb AS (SELECT 'pooled' AS study, grid_id FROM (SELECT *, row_number() OVER (ORDER BY round(mean_auc, 12) DESC NULLS LAST, grid_id) AS r FROM cvm) WHERE r = 1)"
_POOLED = "pw AS (SELECT 'pooled' AS study, CAST(study AS VARCHAR) || ':' || CAST(row_id AS VARCHAR) AS row_id, features, y FROM v_wide)"


@query(
    "cv_out_of_fold",
    with_views(
        """SELECT m.row_id, m.study AS fold, CAST(m.y AS INTEGER) AS label, round(1 / (1 + exp(-m.margin)), 6) AS prob
FROM cm_ m JOIN fits f ON f.fit_id = m.model JOIN cvb ON cvb.grid_id = (f.fit_no - 1) * %d + list_position([%s], m.nrounds)"""
        % (len(TEST_GRID["nrounds"]), ", ".join(map(str, TEST_GRID["nrounds"]))),
        "v_wide",
        extra=_cv_sql() + ",\n" + _BEST_CV,
    ),
)
def q_cv_out_of_fold(spark, sf):
    """Out-of-fold probability of every pooled row under the chosen grid row."""
    oof = reuse(B.out_of_fold(v_wide(spark, sf), TEST_GRID, CV_K, MAX_BINS, CV_SEED))
    best = B.cv_select(B.cv_aucs(oof)[1]).select("grid_id")
    return rounded(oof.join(best, "grid_id").select("row_id", "fold", "label", sigmoid("margin").alias("prob")), 6, "prob")


@query(
    "cv_final_fit",
    with_views(
        _TREES_SQL_OUT.replace("FROM trees", "FROM z_trees JOIN z_fits f ON f.fit_id = model WHERE tree < f.nrounds"),
        "v_wide",
        extra=",\n".join([_cv_sql(), _BEST_CV, _POOLED, *BS.refit_ctes(TEST_GRID, "cvb", "pw")]),
    ),
)
def q_cv_final_fit(spark, sf):
    """The centralised model: trees of the chosen grid row on all pooled rows."""
    rows = v_wide(spark, sf)
    _, mean = B.cross_validate(rows, TEST_GRID, CV_K, MAX_BINS, CV_SEED)
    return rounded_trees(B.cv_final(rows, mean, TEST_GRID, MAX_BINS)[0])


def _logit_sql(steps: int = 3) -> str:
    parts = [
        "ld AS (SELECT study, CAST(features[1] AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM v_wide)",
        "lc0 AS (SELECT study, count(*) AS n, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM ld GROUP BY study)",
    ]
    for s in range(steps):
        parts.append(
            f"""lm{s} AS (SELECT study, n, b0, b1, sum(w) AS a, sum(w * x) AS b, sum(w * x * x) AS c, sum(y - p) AS g0, sum((y - p) * x) AS g1
  FROM (SELECT d.*, c.n, c.b0, c.b1, 1.0 / (1.0 + exp(-(c.b0 + c.b1 * d.x))) AS p,
               (1.0 / (1.0 + exp(-(c.b0 + c.b1 * d.x)))) * (1.0 - 1.0 / (1.0 + exp(-(c.b0 + c.b1 * d.x)))) AS w
        FROM ld d JOIN lc{s} c USING (study))
  GROUP BY study, n, b0, b1)"""
        )
        parts.append(
            f"""lc{s + 1} AS (SELECT study, n, b0 + (c * g0 - b * g1) / NULLIF(a * c - b * b, 0) AS b0,
    b1 + (a * g1 - b * g0) / NULLIF(a * c - b * b, 0) AS b1 FROM lm{s})"""
        )
    return ",\n".join(parts)


@query("logit_irls", with_views("SELECT study, n, round(b0, 6) AS b0, round(b1, 6) AS b1 FROM lc3", "v_wide", extra=_logit_sql(3)))
def q_logit_irls(spark, sf):
    w = v_wide(spark, sf).select("study", F.col("features")[0].alias("x"), "y")
    return rounded(compare.logit_irls(w, "x", "y", "study", 3), 6, "b0", "b1")


# ---- the logistic baseline, fitted to convergence ----

_NEWTON = 12  # steps after which Newton's method on these data does not move any more


def _newton_sql(src: str, steps: int = _NEWTON) -> str:
    """CTEs that define ``lg(study, n, b0, b1)`` from ``src(study, x, y)``, on standardised x."""
    parts = [
        f"""lm_ AS (SELECT study, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM {src} GROUP BY study),
ls AS (SELECT study, (x - mean) / sd AS z, y FROM {src} JOIN lm_ USING (study)),
lb0 AS (SELECT study, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM lm_)"""
    ]
    for k in range(steps):
        parts.append(
            f"""lb{k + 1} AS MATERIALIZED (SELECT study, b0 + (c * g0 - b * g1) / (a * c - b * b) AS b0, b1 + (a * g1 - b * g0) / (a * c - b * b) AS b1
  FROM (SELECT study, b0, b1, sum(p * (1 - p)) AS a, sum(p * (1 - p) * z) AS b, sum(p * (1 - p) * z * z) AS c, sum(y - p) AS g0, sum((y - p) * z) AS g1
    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM ls JOIN lb{k} USING (study)) GROUP BY study, b0, b1))"""
        )
    parts.append(f"lg AS (SELECT study, n, b0 - b1 * mean / sd AS b0, b1 / sd AS b1 FROM lb{steps} JOIN lm_ USING (study))")
    return ",\n".join(parts)


_WIDE_XY = "wx AS (SELECT study, row_id, CAST(features[1] AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM v_wide),\n" + _newton_sql("wx")


def _wide_xy(spark, sf):
    return v_wide(spark, sf).select("study", "row_id", F.col("features")[0].alias("x"), "y")


@query("logit_fit", with_views("SELECT study, n, 'fitted' AS status, round(b0, 8) AS b0, round(b1, 8) AS b1 FROM lg", "v_wide", extra=_WIDE_XY))
def q_logit_fit(spark, sf):
    return rounded(logistic.fit(_wide_xy(spark, sf)).select("study", "n", "status", "b0", "b1"), 8, "b0", "b1")


@query(
    "logit_predict",
    with_views("SELECT study, row_id, round(1 / (1 + exp(-(b0 + b1 * x))), 8) AS prob FROM wx JOIN lg USING (study)", "v_wide", extra=_WIDE_XY),
)
def q_logit_predict(spark, sf):
    rows = _wide_xy(spark, sf)
    return rounded(logistic.predict(rows, logistic.fit(rows)).select("study", "row_id", "prob"), 8, "prob")


# The baseline family of the comparison: a logistic model on one score, compared as a model of its own.
BASELINE, BASELINE_SCORE = "logistic", "discount"

_WITH_BASELINE = (
    f"lx AS (SELECT study, CAST(score AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM v_pred WHERE model = '{BASELINE_SCORE}' AND label IS NOT NULL AND score IS NOT NULL),\n"
    + _newton_sql("lx")
    + f""",
vb AS (SELECT study, model, rid, label, CAST(score AS DOUBLE) AS score FROM v_pred
  UNION ALL SELECT v.study, '{BASELINE}', v.rid, v.label, 1 / (1 + exp(-(b0 + b1 * CAST(v.score AS DOUBLE)))) FROM v_pred v JOIN lg USING (study) WHERE v.model = '{BASELINE_SCORE}')"""
)


def with_baseline(pred):
    """``pred`` and the probabilities of a logistic model on the scores of BASELINE_SCORE."""
    one = pred.where(F.col("model") == BASELINE_SCORE)
    p = logistic.predict(one, logistic.fit(one, "score", "label"), "score", "label")
    return pred.select("study", "model", "rid", "label", F.col("score").cast("double").alias("score")).unionByName(
        p.select("study", F.lit(BASELINE).alias("model"), "rid", "label", F.col("prob").alias("score"))
    )


@query(
    "compare_baseline",
    with_views(
        """SELECT study, model AS family, round(a.auc, 6) AS auc, round(b.auc_lo, 6) AS ci_lo, round(b.auc_hi, 6) AS ci_hi FROM a JOIN boot b USING (study, model)""",
        "v_pred",
        extra=_WITH_BASELINE + ",\n" + _AUC.replace("FROM v_pred", "FROM vb") + ",\n" + _boot_sql("vb"),
    ),
)
def q_compare_baseline(spark, sf):
    p = with_baseline(v_pred(spark, sf))  # read twice, never kept: both collapse it to one row a score
    a, ci = roc.auc(p), bootstrap.auc_bootstrap(p, reps=BOOT_REPS, seed=BOOT_SEED)
    table = a.join(ci, ["study", "model"]).select("study", F.col("model").alias("family"), "auc", F.col("auc_lo").alias("ci_lo"), F.col("auc_hi").alias("ci_hi"))
    return rounded(table, 6, "auc", "ci_lo", "ci_hi")
