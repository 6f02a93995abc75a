"""Query keys for boosted-tree training on ``v_wide`` (4 studies, 8 features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boost as B
from ..operators import roc, sketch
from . import boost_sql as BS
from .registry import query, rounded
from .views import v_wide, with_views

# A small grid for the checked queries (2 rounds, depth 2, 4 fits per study).
TEST_GRID = {
    "nrounds": [1, 2],
    "eta": [0.3],
    "max_depth": [2],
    "gamma": [0.0],
    "colsample_bytree": [0.75, 1.0],
    "subsample": [0.8, 1.0],
}
ONE_ROUND = {**TEST_GRID, "nrounds": [1]}
MAX_BINS = None  # exact candidates: every distinct value


def _fit_sql(grid: dict, body: str) -> str:
    return with_views(body, "v_wide", extra=",\n".join(BS.fit_ctes(grid, MAX_BINS)))


def _base_sql(body: str, rounds: int = 1, depth: int = 2) -> str:
    ctes = BS.base(TEST_GRID, MAX_BINS)
    for r in range(1, rounds + 1):
        ctes += BS.round_ctes(r, depth)
    return with_views(body, "v_wide", extra=",\n".join(ctes))


def _state1(spark, sf):
    rows = v_wide(spark, sf)
    fits = B.fits_of(rows, TEST_GRID)
    br = B.bin_rows(rows, B.value_bins(rows, MAX_BINS))
    st = br.join(fits.select("study", "fit_id", "subsample"), "study").select(
        "fit_id", "study", "row_id", F.col("y").cast("double").alias("y"), "bins", "subsample", F.lit(0.0).alias("margin")
    )
    st = B.grad_hess(st).withColumn("keep", B.row_keep(1)).withColumn("node", F.lit(0).cast("bigint"))
    return st.withColumn("leaf", F.lit(None).cast("double")), fits


def _R6(c):
    """Round to 6 digits; ``+ 0.0`` turns -0.0 into 0.0 (engines differ in printing the sign)."""
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


@query(
    "param_grid",
    with_views(
        "SELECT s.study, g.* FROM (SELECT DISTINCT study FROM v_wide) s CROSS JOIN "
        + BS.grid_values(B.REFERENCE_GRID, list(B.REFERENCE_GRID), "grid_id"),
        "v_wide",
    ),
)
def q_param_grid(spark, sf):
    return B.param_grid(v_wide(spark, sf).select("study").distinct(), B.REFERENCE_GRID)


@query("feature_bins", _base_sql("SELECT study, feature, bin, lo, hi, cut FROM bins", rounds=0))
def q_feature_bins(spark, sf):
    return B.feature_bins(v_wide(spark, sf), MAX_BINS)


WEIGHTED_BINS = 16


@query(
    "weighted_cuts",
    with_views(
        f"""SELECT study, feature, max(bin)::INTEGER AS bin, cut FROM (SELECT s.study, s.feature, t.bin, min(s.value) AS cut
  FROM ws s CROSS JOIN range(1, {WEIGHTED_BINS}) t(bin) WHERE s.below >= s.total * t.bin / {WEIGHTED_BINS} - 1e-9 GROUP BY ALL) GROUP BY study, feature, cut""",
        "v_wide",
        extra="""wl AS (SELECT study, CAST(unnest(range(len(features))) AS INTEGER) AS feature, unnest(features) AS value, 1 + row_id % 3 AS weight FROM v_wide),
wv AS (SELECT study, feature, value, CAST(sum(weight) AS DOUBLE) AS w FROM wl WHERE value IS NOT NULL GROUP BY ALL),
ws AS (SELECT *, sum(w) OVER (PARTITION BY study, feature ORDER BY value) - w AS below, sum(w) OVER (PARTITION BY study, feature) AS total FROM wv)""",
    ),
)
def q_weighted_cuts(spark, sf):
    """Bin borders by weight, from the mergeable summaries."""
    rows = v_wide(spark, sf).select("study", (1 + F.col("row_id") % 3).alias("weight"), F.posexplode("features").alias("feature", "value"))
    return sketch.weighted_cuts(rows, WEIGHTED_BINS).drop("rank_error")


@query("grad_hess", _base_sql("SELECT fit_id, row_id, y, margin, round(g, 6) AS g, round(h, 6) AS h FROM s_r1_l0"))
def q_grad_hess(spark, sf):
    st, _ = _state1(spark, sf)
    return st.select("fit_id", "row_id", "y", "margin", _R6("g"), _R6("h"))


@query("row_subsample", _base_sql("SELECT fit_id, row_id, keep FROM s_r1_l0"))
def q_row_subsample(spark, sf):
    st, _ = _state1(spark, sf)
    return st.select("fit_id", "row_id", "keep")


@query("col_sample", _base_sql("SELECT fit_id, feature, keep FROM al_r1"))
def q_col_sample(spark, sf):
    rows = v_wide(spark, sf)
    return B.col_sample(B.fits_of(rows, TEST_GRID), BS.N_FEATURES, 1)


@query(
    "split_histogram",
    _base_sql("SELECT fit_id, node, feature, bin, round(sg, 6) AS sg, round(sh, 6) AS sh, n FROM hist_r1_l0"),
)
def q_split_histogram(spark, sf):
    st, fits = _state1(spark, sf)
    h = B.split_histogram(st, B.col_sample(fits, BS.N_FEATURES, 1))
    return h.select("fit_id", "node", "feature", "bin", _R6("sg"), _R6("sh"), "n")


@query(
    "best_split",
    _base_sql(
        "SELECT fit_id, node, feature, bin, round(gl, 6) AS gl, round(hl, 6) AS hl, round(gt, 6) AS gt, "
        "round(ht, 6) AS ht, default_left, gain FROM best_r1_l0"
    ),
)
def q_best_split(spark, sf):
    st, fits = _state1(spark, sf)
    b = B.best_split(B._histogram(st, B.col_sample(fits, BS.N_FEATURES, 1))).where("gain is not null")
    return b.select("fit_id", "node", "feature", "bin", _R6("gl"), _R6("hl"), _R6("gt"), _R6("ht"), "default_left", "gain")


@query("route_rows", _base_sql("SELECT fit_id, row_id, node, round(leaf, 6) AS leaf FROM s_r1_l1"))
def q_route_rows(spark, sf):
    st, fits = _state1(spark, sf)
    hist = B.level_histogram(st, B.col_sample(fits, BS.N_FEATURES, 1), None)
    nxt, *_ = B.grow_level(st, fits, hist, 0, B.LAMBDA, B.MIN_CHILD_WEIGHT)
    return nxt.select("fit_id", "row_id", "node", _R6("leaf"))


@query("leaf_update", _fit_sql(ONE_ROUND, "SELECT fit_id, row_id, round(margin, 6) AS margin FROM preds"))
def q_leaf_update(spark, sf):
    _, preds, _ = B.fit_boosted(v_wide(spark, sf), ONE_ROUND, MAX_BINS)
    return preds.select("fit_id", "row_id", _R6("margin"))


TREE_OUT = ["model", "tree", "node", "depth", "feature", "threshold", "default_left", "left", "right", "leaf_value", "gain", "cover"]
_TREES_SQL_OUT = (
    'SELECT model, tree, node, depth, feature, round(threshold, 6) + 0.0 AS threshold, default_left, "left", "right", '
    "round(leaf_value, 6) + 0.0 AS leaf_value, round(gain, 6) + 0.0 AS gain, round(cover, 6) + 0.0 AS cover FROM trees"
)


def rounded_trees(t):
    return t.select(
        "model", "tree", "node", "depth", "feature", _R6("threshold"), "default_left", "left", "right",
        _R6("leaf_value"), _R6("gain"), _R6("cover"),
    )


@query("fit_boosted", _fit_sql(TEST_GRID, _TREES_SQL_OUT))
def q_fit_boosted(spark, sf):
    trees, _, _ = B.fit_boosted(v_wide(spark, sf), TEST_GRID, MAX_BINS)
    return rounded_trees(trees)


@query("fit_boosted_keyed", _fit_sql(TEST_GRID, _TREES_SQL_OUT))
def q_fit_boosted_keyed(spark, sf):
    trees, _, _ = B.fit_boosted(v_wide(spark, sf), TEST_GRID, MAX_BINS, method="keyed")
    return rounded_trees(trees)


_AUC_OF_PREDS = """pr AS (SELECT p.study, (f.fit_no - 1) * {nr} + list_position({rounds}, p.nrounds) AS grid_id, p.nrounds,
    CAST(p.y AS INTEGER) AS label, round(p.margin, 9) AS score, p.margin
  FROM preds p JOIN fits f USING (fit_id, study)),
ca AS (SELECT study, grid_id, score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM pr GROUP BY ALL),
au AS (SELECT study, grid_id, sum(pos * ((neg_cum - neg) + CAST(neg AS DOUBLE) * 0.5))
         / NULLIF(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
  FROM (SELECT ca.*, sum(neg) OVER (PARTITION BY study, grid_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM ca)
  GROUP BY study, grid_id),
best AS (SELECT study, grid_id, auc FROM (
  SELECT *, row_number() OVER (PARTITION BY study ORDER BY auc DESC NULLS LAST, grid_id) AS rk FROM au) WHERE rk = 1)"""


def grid_aucs(preds, fits, grid):
    """Training AUC per (study, grid_id) from the prefix predictions."""
    nr = grid["nrounds"]
    pos = F.array_position(F.array(*[F.lit(int(n)) for n in nr]), F.col("nrounds"))
    p = preds.join(fits.select("fit_id", "study", "fit_no"), ["fit_id", "study"]).select(
        "study",
        ((F.col("fit_no") - 1) * len(nr) + pos).cast("int").alias("grid_id"),
        F.col("y").cast("int").alias("label"),
        F.round("margin", 9).alias("score"),
    )
    return roc.auc(p, keys=["study", "grid_id"]).select("study", "grid_id", "auc")


@query(
    "select_best",
    with_views(
        "SELECT study, grid_id, round(auc, 6) AS auc FROM best",
        "v_wide",
        extra=",\n".join(BS.fit_ctes(TEST_GRID, MAX_BINS))
        + ",\n"
        + _AUC_OF_PREDS.format(nr=len(TEST_GRID["nrounds"]), rounds=TEST_GRID["nrounds"]),
    ),
)
def q_select_best(spark, sf):
    _, preds, fits = B.fit_boosted(v_wide(spark, sf), TEST_GRID, MAX_BINS)
    return rounded(B.select_best(grid_aucs(preds, fits, TEST_GRID)), 6, "auc")
