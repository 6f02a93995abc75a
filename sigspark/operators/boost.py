"""Gradient-boosted trees (logistic loss) trained as keyed DataFrame jobs.

Every (study, hyper-parameter) combination is one *fit*; all fits of all
studies grow together, and a study's rows only ever meet fits of the same
study (the fit key carries the study), so cohorts are never pooled.

State: one row per (fit, sample) with the sample's feature bins, label,
current margin and current node.  One boosting level is

1. gradients g = p - y, Hessians h = p (1 - p), p = sigmoid(margin);
2. ``split_histogram``: explode the bins of in-sample rows over the fit's
   sampled features and aggregate (fit, node, feature, bin) -> (sum g, sum h);
   a partial (map-side) aggregate, so no fit, study or node is gathered;
3. ``best_split``: running sums over bins inside (fit, node, feature) give, for
   both directions of the rows with a missing value,
   gain = GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l); both children need
   H >= min_child_weight; the best per (fit, node) by (gain rounded to 1e-9
   desc, feature, bin); a node splits when gain > gamma (and > 1e-6);
4. ``route``: join the (small) split table on (fit, node): bin <= split bin
   goes left (child 2n+1), else right (2n+2); a missing bin takes the
   direction that the search found better (``default_left``);
5. nodes that do not split become leaves with w = -eta G / (H + l); after the
   last level every row adds its leaf value to its margin.

Rows left out by ``subsample`` are routed and updated but add nothing to the
histograms.  Column sampling keeps, per (fit, round), the
max(1, floor(colsample * F)) features with the smallest md5 draw.  Base
margin is 0.  Fits that differ only in ``nrounds`` share one fit (the
shorter are prefixes of the longer), so a grid of k round counts costs one
fit of the largest.

The two children of a split share their parent's histogram: only the child with
fewer in-sample rows is aggregated, its sibling is the parent less it.  Rows that
have reached a leaf leave the level loop, and so do fits that are at their depth.

The driver only runs the level loop (rounds x depth).  Each level's rows and
histogram, each round's trees and margins, are written under one folder
of the shared ``spark.checkpoint.dir`` and read again, so a plan never holds more than
one round, and a fit that was stopped goes on after its last whole round (``state_path``).

Cohorts that fit in a task are grown there instead, all fits in one job
(:mod:`sigspark.operators.cohort_fits`): same draws, same ties, same trees.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import md5_uniform, sigmoid
from ..session import cut_lineage, reuse, scratch_path
from . import cohort_fits
from .scan import ordered_scan

# The reference's hyper-parameter grid (first factor varies fastest).
REFERENCE_GRID = {
    "nrounds": [10, 60, 110, 160, 210, 260],
    "eta": [0.01, 0.0825, 0.155, 0.2275, 0.3],
    "max_depth": [3, 6, 9],
    "gamma": [0.0, 0.1, 0.5, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "subsample": [0.6, 0.8, 1.0],
}
LAMBDA = 1.0
MIN_CHILD_WEIGHT = 1.0
MIN_GAIN = 1e-6
SLACK = cohort_fits.SLACK
SLAB = 1 << 15  # bins of a feature whose running sums are one window


def param_grid(keys: DataFrame, values: dict | None = None) -> DataFrame:
    """Cartesian grid of hyper-parameters for every row of ``keys``.

    Built by chained ``posexplode`` of literal arrays (generators, not a
    join); ``grid_id`` numbers the grid 1..n with the first factor fastest.
    """
    values = values or REFERENCE_GRID
    names = list(values)
    df = keys
    for n in names:
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values[n]])).alias(f"_i_{n}", n))
    gid = F.lit(0)
    mult = 1
    for n in names:
        gid = gid + F.col(f"_i_{n}") * mult
        mult *= len(values[n])
    return df.withColumn("grid_id", (gid + 1).cast("int")).drop(*[f"_i_{n}" for n in names])


def grad_hess(state: DataFrame) -> DataFrame:
    p = sigmoid("margin")
    return state.withColumn("g", p - F.col("y")).withColumn("h", p * (F.lit(1.0) - p))


def long_features(rows: DataFrame, keys: Sequence[str] = ("study", "row_id")) -> DataFrame:
    return rows.select(*keys, F.posexplode("features").alias("feature", "value"))


def value_bins(rows: DataFrame, max_bins: int | None = None, buckets: int | None = None) -> DataFrame:
    """Bin of every distinct known value per (study, feature): study, feature, value, bin.

    Values are ranked by the skew-safe ordered scan.  ``max_bins=None`` (exact) gives every
    value a bin of its own; a number asks for quantile bins, floor((rank - 1) max_bins / m) of m values.
    """
    d = long_features(rows).where(F.col("value").isNotNull()).select("study", "feature", "value").distinct().withColumn("one", F.lit(1))
    s = ordered_scan(d, ["study", "feature"], ["value"], sums=["one"], buckets=buckets)
    if max_bins is None:
        return s.select("study", "feature", "value", (F.col("one_cum") - 1).cast("int").alias("bin"))
    m = d.groupBy("study", "feature").agg(F.count(F.lit(1)).alias("m"))
    b = F.floor((F.col("one_cum") - 1) * max_bins / F.col("m"))
    return s.join(m, ["study", "feature"]).select("study", "feature", "value", b.cast("int").alias("bin"))


def feature_bins(rows: DataFrame, max_bins: int | None = None, values: DataFrame | None = None) -> DataFrame:
    """Candidate cuts per (study, feature): study, feature, bin, lo, hi, cut.

    The cut after bin b is the midpoint between the largest value of b and the
    smallest of the next bin (NULL after the last one).
    """
    v = value_bins(rows, max_bins) if values is None else values
    per = v.groupBy("study", "feature", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    s = ordered_scan(per, ["study", "feature"], ["bin"], bwd=["lo"])  # a feature may have as many bins as there are rows
    return s.select("study", "feature", "bin", "lo", "hi", ((F.col("hi") + F.col("lo_next")) / 2).alias("cut"))


def bin_rows(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Rows with ``bins array<int>``: always one entry a feature, NULL where the value is missing.

    Known values meet their bin by an equi-join on (study, feature, value); rows without any known value stay.
    """
    lf = long_features(rows).where(F.col("value").isNotNull())
    per = lf.join(values, ["study", "feature", "value"]).groupBy("study", "row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "bin"))).alias("fb")
    )
    known = F.transform(F.sequence(F.lit(0), F.size("features") - 1), lambda i: F.try_element_at(F.col("fb"), i))
    none = F.array_repeat(F.lit(None).cast("int"), F.size("features"))
    return rows.join(per, ["study", "row_id"], "left").select(
        *[c for c in rows.columns if c != "features"], F.when(F.col("fb").isNull(), none).otherwise(known).alias("bins")
    )


def fits_of(rows: DataFrame, grid_values: dict) -> DataFrame:
    """One row per (study, fit): the grid without ``nrounds`` (prefix sharing) for every study.

    ``fit_id`` = study and the grid index of the remaining factors; ``rounds``
    lists the round counts to evaluate.
    """
    vals = {k: v for k, v in grid_values.items() if k != "nrounds"}
    studies = rows.select("study").distinct()
    g = param_grid(studies, vals).withColumnRenamed("grid_id", "fit_no")
    return g.select(
        "study",
        F.concat_ws(":", F.col("study").cast("string"), F.col("fit_no").cast("string")).alias("fit_id"),
        "fit_no",
        *vals,
        F.array(*[F.lit(int(n)) for n in grid_values["nrounds"]]).alias("rounds"),
    )


def col_sample(fits: DataFrame, n_features: int, rnd: int) -> DataFrame:
    """Allowed features per fit for round ``rnd``: the k smallest md5 draws, k = max(1, floor(colsample F))."""
    x = fits.select("fit_id", "colsample_bytree", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("feature"))
    x = x.withColumn("u", md5_uniform(F.col("fit_id"), F.lit(rnd), F.col("feature")))
    w = Window.partitionBy("fit_id").orderBy("u", "feature")
    k = F.greatest(F.lit(1), F.floor(F.col("colsample_bytree") * n_features))
    return x.withColumn("rk", F.row_number().over(w)).select("fit_id", "feature", (F.col("rk") <= k).alias("keep"))


def row_keep(rnd: int):
    return md5_uniform(F.col("fit_id"), F.lit(rnd), F.col("row_id")) < F.col("subsample")


def _histogram(state: DataFrame, allowed: DataFrame) -> DataFrame:
    """One aggregate over the state: (fit, node, feature, bin) sums plus node totals as feature -1.

    Each in-sample active row explodes its bins over the fit's sampled
    features and one extra element (feature -1, bin -1) that carries the node
    totals, so histograms and totals come from a single pass over the state.
    ``allowed`` becomes one array per fit (at most F entries) joined on fit_id.
    Where the state has a column ``build``, only its rows with it are read.
    """
    arr = allowed.where("keep").groupBy("fit_id").agg(F.collect_list("feature").alias("allowed"))
    read = F.col("keep") & F.col("node").isNotNull()
    x = state.where(read & F.col("build") if "build" in state.columns else read).join(arr, "fit_id").select(
        "fit_id", "node", "g", "h", "allowed",
        F.posexplode(F.concat(F.col("bins"), F.array(F.lit(-1)))).alias("pos", "bin"),
        F.size("bins").alias("nf"),
    )
    feat = F.when(F.col("pos") == F.col("nf"), F.lit(-1)).otherwise(F.col("pos")).cast("int")
    x = x.withColumn("feature", feat).where(
        (F.col("feature") == -1) | (F.col("bin").isNotNull() & F.array_contains("allowed", F.col("feature")))
    )
    return x.groupBy("fit_id", "node", "feature", "bin").agg(
        F.sum("g").alias("sg"), F.sum("h").alias("sh"), F.count(F.lit(1)).alias("n")
    )


def level_histogram(state: DataFrame, allowed: DataFrame, parent: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Histogram of a level: the children marked ``build`` from rows, each sibling as its parent's less that one.

    ``parent`` is the level before: its histogram and its decisions (fit_id, node, split, nl, nt).
    """
    built = _histogram(state, allowed)
    if parent is None:
        return built
    hist, dec = parent
    left, right, small_left = F.col("node") * 2 + 1, F.col("node") * 2 + 2, _small_left()
    kids = dec.where("split").select("fit_id", "node", F.when(small_left, left).otherwise(right).alias("small"), F.when(small_left, right).otherwise(left).alias("other"))
    whole = hist.join(kids, ["fit_id", "node"]).select("fit_id", "small", "other", "feature", "bin", "sg", "sh", "n")
    less = built.select("fit_id", F.col("node").alias("small"), "feature", "bin", *[F.col(c).alias(f"b_{c}") for c in ("sg", "sh", "n")])
    rest = whole.join(less, ["fit_id", "small", "feature", "bin"], "left").select(
        "fit_id", F.col("other").alias("node"), "feature", "bin", *[(F.col(c) - F.coalesce(F.col(f"b_{c}"), F.lit(0))).alias(c) for c in ("sg", "sh", "n")]
    )
    return built.unionByName(rest.where("n > 0"))


def _small_left():
    """Whether the left child has at most half of a split node's in-sample rows."""
    return F.col("nl") * 2 <= F.col("nt")


def split_histogram(state: DataFrame, allowed: DataFrame) -> DataFrame:
    """(fit, node, feature, bin) -> sum g, sum h, n over in-sample active rows and allowed features."""
    return _histogram(state, allowed).where(F.col("feature") >= 0)


def node_totals(state: DataFrame) -> DataFrame:
    return (
        state.where(F.col("keep") & F.col("node").isNotNull())
        .groupBy("fit_id", "node")
        .agg(F.sum("g").alias("gt"), F.sum("h").alias("ht"))
    )


def best_split(hist: DataFrame, lam: float = LAMBDA, mcw: float = MIN_CHILD_WEIGHT) -> DataFrame:
    """Best split and totals of every (fit, node), from one exchange of :func:`_histogram`'s table.

    A feature may have a bin for every row, so the bins are cut into slabs of SLAB: the histogram is hash-partitioned once by
    (fit, node, feature, slab), which serves the slabs' totals and the running sums inside them; the totals of the slabs before are
    added, and the arg-max is an aggregate.  No task holds more than a slab, whatever a node's bins.

    After every bin that has a known value on its right, both directions of the rows
    with a missing value are tried: their sums (node total minus known total) go left or right.
    A split is valid when both children have H >= min_child_weight (up to SLACK: a sum that is just that much must not depend on its order); the highest gain
    (equal to 1e-9) wins, then the lower feature, the lower bin, and the left direction.
    Output: fit_id, node, gt, ht, nt, gl, hl, nl, feature, bin, default_left, gain (all from gl NULL without a valid split);
    nt and nl are the in-sample rows of the node and of its left child.
    """
    node, sums = ["fit_id", "node"], {"sg": "g", "sh": "h", "n": "n"}
    slab = [*node, "feature", "slab"]
    h = hist.withColumn("slab", F.expr(f"bin div {SLAB}")).repartition(*slab)
    totals = hist.where("feature = -1").select(*node, *[F.col(c).alias(f"{k}t") for c, k in sums.items()])
    wf = Window.partitionBy(*node, "feature")
    before = wf.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = h.where("feature >= 0").groupBy(*slab).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    slabs = slabs.select(*slab, *[F.sum(f"_{c}").over(wf).alias(f"{k}s") for c, k in sums.items()], *[F.sum(f"_{c}").over(before).alias(f"{k}b") for c, k in sums.items()])
    run = Window.partitionBy(*slab).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = h.where("feature >= 0").select(*slab, "bin", *[F.sum(c).over(run).alias(f"{k}r") for c, k in sums.items()]).join(slabs, slab).join(totals, node)
    x = x.withColumns({f"{k}k": F.coalesce(F.col(f"{k}b"), F.lit(0)) + F.col(f"{k}r") for k in sums.values()})
    whole = [(F.col(k) + F.col(t) - F.col(s)).alias(o) for k, t, s, o in (("gk", "gt", "gs", "gl"), ("hk", "ht", "hs", "hl"), ("nk", "nt", "ns", "nl"))]
    sides = F.array(
        F.struct(F.lit(True).alias("default_left"), *whole),
        F.struct(F.lit(False).alias("default_left"), *[F.col(k).alias(o) for k, o in (("gk", "gl"), ("hk", "hl"), ("nk", "nl"))]),
    )
    x = x.withColumn("side", F.explode(sides)).select("fit_id", "node", "feature", "bin", "gt", "ht", "nt", "nk", "ns", "side.*")
    gl, hl, lm = F.col("gl"), F.col("hl"), F.lit(lam)
    gr, hr = F.col("gt") - gl, F.col("ht") - hl
    valid = (F.col("feature") >= 0) & (F.col("nk") < F.col("ns")) & (hl >= mcw - SLACK) & (hr >= mcw - SLACK)
    gain = gl * gl / (hl + lm) + gr * gr / (hr + lm) - F.col("gt") * F.col("gt") / (F.col("ht") + lm)
    x = x.withColumn("gain", F.when(valid, F.round(gain, 9)))
    # the highest gain (a missing one is the lowest), then the lower feature, the lower bin, and the left direction
    rank = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "default_left", "gl", "hl", "nl")
    top = x.groupBy(*node).agg(F.max(rank).alias("m"))
    best = top.where("m.gain is not null").select(
        *node, "m.gl", "m.hl", "m.nl", (-F.col("m.f")).alias("feature"), (-F.col("m.b")).alias("bin"), "m.default_left", "m.gain"
    )
    return totals.join(best, node, "left").select(*node, "gt", "ht", "nt", "gl", "hl", "nl", "feature", "bin", "default_left", "gain")


def _leaf(lam: float):
    return -F.col("eta") * F.col("gt") / (F.col("ht") + F.lit(lam))


def grow_level(state: DataFrame, fits: DataFrame, hist: DataFrame, depth: int, lam: float, mcw: float):
    """One level for all fits from its histogram: returns (new state, tree rows of this level, decisions (persisted))."""
    cand = best_split(hist, lam, mcw).join(
        fits.select("fit_id", "eta", "max_depth", "gamma"), "fit_id"
    )
    do_split = F.col("gain").isNotNull() & (F.col("gain") > F.col("gamma")) & (F.col("gain") > MIN_GAIN) & (
        F.lit(depth) < F.col("max_depth")
    )
    dec = reuse(cand.withColumn("split", do_split))  # small (fit, node) table read by nodes, splits and leaves
    # one routing table: split nodes carry (feature, bin), leaf nodes their value
    route = dec.select(
        "fit_id", "node",
        F.when(F.col("split"), F.col("feature")).alias("feature"),
        F.when(F.col("split"), F.col("bin")).alias("sbin"),
        F.when(F.col("split"), F.col("default_left")).alias("missing_left"),
        F.when(F.col("split"), _small_left()).alias("small_left"),
        F.when(~F.col("split"), _leaf(lam)).alias("leaf_value"),
    )
    nodes = dec.select(
        "fit_id", "node", F.lit(depth).alias("depth"),
        F.when(F.col("split"), F.col("feature")).alias("feature"),
        F.when(F.col("split"), F.col("bin")).alias("bin"),
        F.when(F.col("split"), F.col("default_left")).alias("default_left"),
        F.when(F.col("split"), F.col("node") * 2 + 1).alias("left"),
        F.when(F.col("split"), F.col("node") * 2 + 2).alias("right"),
        F.when(~F.col("split"), _leaf(lam)).alias("leaf_value"),
        F.when(F.col("split"), F.col("gain")).alias("gain"),
        F.col("ht").alias("cover"),
    )
    st = state.join(route, ["fit_id", "node"], "left")
    b = F.element_at(F.col("bins"), F.col("feature") + 1)
    go_left = F.when(b.isNull(), F.col("missing_left")).otherwise(b <= F.col("sbin"))
    new_node = F.when(F.col("sbin").isNotNull(), F.when(go_left, F.col("node") * 2 + 1).otherwise(F.col("node") * 2 + 2))
    st = st.select(
        *[c for c in state.columns if c not in ("node", "leaf", "build")],
        F.when(F.col("node").isNotNull(), new_node).alias("node"),
        F.coalesce(F.col("leaf_value"), F.col("leaf")).alias("leaf"),
        (go_left == F.col("small_left")).alias("build"),
    )
    return st, nodes, dec


def close_tree(state: DataFrame, fits: DataFrame, depth: int, lam: float):
    """Nodes still open after the last level become leaves."""
    tot = node_totals(state).join(fits.select("fit_id", "eta"), "fit_id")
    leaves = reuse(tot.select("fit_id", "node", _leaf(lam).alias("leaf_value"), F.col("ht").alias("cover")))
    nodes = leaves.select(
        "fit_id", "node", F.lit(depth).alias("depth"), F.lit(None).cast("int").alias("feature"),
        F.lit(None).cast("int").alias("bin"), F.lit(None).cast("boolean").alias("default_left"), F.lit(None).cast("bigint").alias("left"),
        F.lit(None).cast("bigint").alias("right"), "leaf_value", F.lit(None).cast("double").alias("gain"), "cover",
    )
    st = state.join(leaves.select("fit_id", "node", "leaf_value"), ["fit_id", "node"], "left").select(
        *[c for c in state.columns if c != "leaf"], F.coalesce(F.col("leaf_value"), F.col("leaf")).alias("leaf")
    )
    return st, nodes, leaves


TREE_COLUMNS = ("tree", "node", "depth", "feature", "threshold", "default_left", "left", "right", "leaf_value", "gain", "cover")


def fit_boosted(rows: DataFrame, grid_values: dict, max_bins: int | None = None, lam: float = LAMBDA, mcw: float = MIN_CHILD_WEIGHT, use_gamma: bool = True, **how):
    """Train every (study, grid row) fit; see :func:`train_fits` for the rows, the results and ``how``.

    Fits that differ only in ``nrounds`` are one fit; ``use_gamma=False`` leaves the grid's gamma out.
    """
    fits = fits_of(rows.where("study is not null"), grid_values)
    if not use_gamma:
        fits = fits.withColumn("gamma", F.lit(0.0))
    return train_fits(rows, fits, max_bins, lam, mcw, **how)


def train_fits(
    rows: DataFrame, fits: DataFrame, max_bins: int | None = None, lam: float = LAMBDA, mcw: float = MIN_CHILD_WEIGHT, method: str = "auto", state_path: str | None = None,
):
    """Train ``fits(study, fit_id, fit_no, eta, max_depth, gamma, colsample_bytree, subsample, rounds)`` on the rows of their study.

    ``rows(study, row_id, features array<double>, y int)``; rows without a study are in no fit.  Returns
    ``(trees, preds, fits)``: the tree table (one row per node, keyed by
    fit_id and round), the training margins at every requested round count
    (``preds(fit_id, study, nrounds, row_id, y, margin)``), and the fits.

    ``method``: "cohort" grows each fit inside a task, "keyed" grows all fits level by level
    as DataFrame jobs; "auto" measures the largest cohort and takes the first
    where it has ``cohort_fits.CELLS`` cells at most.  A keyed training keeps its state under ``state_path`` (a folder that all executors
    see; a new one under ``spark.checkpoint.dir`` by default) and, called again with it, goes on after the last whole round.
    """
    if method not in ("auto", "cohort", "keyed"):
        raise ValueError(f"unknown method {method!r}")
    spark = rows.sparkSession
    rows = rows.where("study is not null")
    per = rows.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("f"))
    largest, n_features = (int(v or 0) for v in per.agg(F.max("n"), F.max("f")).first())
    if method == "auto":
        method = "cohort" if state_path is None and largest * max(1, n_features) <= cohort_fits.CELLS else "keyed"
    if method == "keyed":
        return _fit_keyed(rows, fits, n_features, max_bins, lam, mcw, state_path)
    fits = cut_lineage(fits)
    each = -(-fits.count() // (2 * spark.sparkContext.defaultParallelism))
    path = scratch_path(spark, "cohort-fits")
    found = cohort_fits.fit_cohorts(rows, fits, max(1, min(cohort_fits.CHUNK_FITS, each)), n_features, max_bins, lam, mcw, MIN_GAIN)
    found.write.partitionBy("kind").parquet(path)
    out = spark.read.schema(found.schema).parquet(path)
    trees = out.where("kind = 0").select(F.col("fit_id").alias("model"), *TREE_COLUMNS)
    return trees, out.where("kind = 1").select("fit_id", "study", "nrounds", "row_id", "y", "margin"), fits


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _last_round(spark: SparkSession, path: str) -> int:
    """The last whole round of the state under ``path``; -1 where nothing is there."""
    try:
        return spark.read.parquet(f"{path}/done").agg(F.max("round")).first()[0]
    except AnalysisException:
        return -1


def _mark(spark: SparkSession, path: str, rnd: int) -> None:
    spark.range(1).select(F.lit(rnd).alias("round")).coalesce(1).write.mode("overwrite").parquet(f"{path}/done/at={rnd}")


def _fit_keyed(rows, fits, n_features, max_bins, lam, mcw, state_path):
    spark = rows.sparkSession
    path = state_path or scratch_path(spark, "fit")
    done = _last_round(spark, path)
    if done < 0:
        _written(fits, f"{path}/fits")
    else:  # the same fits, or the state is of no use
        other = fits.exceptAll(spark.read.parquet(f"{path}/fits")).count() or fits.count() != spark.read.parquet(f"{path}/fits").count()
        if other or spark.read.parquet(f"{path}/spec").first()[0] != _spec(n_features, max_bins, lam, mcw):
            raise ValueError(f"{path} holds the state of another fit")
    fits = spark.read.parquet(f"{path}/fits")
    if done < 0:
        values = reuse(value_bins(rows, max_bins))
        feature_bins(rows, max_bins, values).select("study", "feature", "bin", "cut").write.mode("overwrite").parquet(f"{path}/cuts")
        state = bin_rows(rows, values).join(fits.select("study", "fit_id", "subsample"), "study").select(
            "fit_id", "study", "row_id", F.col("y").cast("double").alias("y"), "bins", "subsample", F.lit(0.0).alias("margin"),
        )
        state.write.mode("overwrite").parquet(f"{path}/state/0")
        values.unpersist()
        spark.createDataFrame([(_spec(n_features, max_bins, lam, mcw),)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
        _mark(spark, path, 0)
        done = 0
    deepest, last = fits.agg(F.max("max_depth"), F.max(F.array_max("rounds"))).first()
    wanted = sorted(r[0] for r in fits.select(F.explode("rounds")).distinct().collect())  # the grid's round counts
    for rnd in range(done + 1, (last or 0) + 1):
        _round(spark, path, fits, n_features, rnd, int(deepest), lam, mcw, rnd in wanted)
        _mark(spark, path, rnd)
    if not last:
        empty = "fit_id string, node bigint, depth int, feature int, bin int, default_left boolean, left bigint, right bigint, leaf_value double, gain double, cover double, round int"
        trees, preds = spark.createDataFrame([], empty), spark.read.parquet(f"{path}/state/0").withColumn("nrounds", F.lit(0))
    else:
        trees = spark.read.option("basePath", f"{path}/trees").parquet(*[f"{path}/trees/round={r}" for r in range(1, last + 1)])
        preds = spark.read.option("basePath", f"{path}/preds").parquet(*[f"{path}/preds/nrounds={r}" for r in wanted])
    cuts = spark.read.parquet(f"{path}/cuts").withColumnRenamed("cut", "threshold")
    trees = trees.withColumn("tree", (F.col("round") - 1).cast("int")).join(fits.select("fit_id", "study"), "fit_id").join(cuts, ["study", "feature", "bin"], "left")
    preds = preds.withColumn("nrounds", F.col("nrounds").cast("int"))
    return trees.select(F.col("fit_id").alias("model"), *TREE_COLUMNS), preds.select("fit_id", "study", "nrounds", "row_id", "y", "margin"), fits


def _spec(*parts) -> str:
    return json.dumps(parts)


def _round(spark: SparkSession, path: str, fits: DataFrame, n_features: int, rnd: int, max_depth: int, lam: float, mcw: float, wanted: bool) -> None:
    """One tree for every fit, from the state of the round before to the state, the trees and (where wanted) the margins of this one.

    Fits that want fewer rounds are dropped from the state.
    """
    fits = fits.where(F.array_max("rounds") >= rnd)
    allowed = reuse(col_sample(fits, n_features, rnd))
    state = spark.read.parquet(f"{path}/state/{(rnd - 1) % 2}").join(fits.select("fit_id"), "fit_id", "left_semi")
    st = grad_hess(state).withColumn("keep", row_keep(rnd))
    st = st.withColumns({"node": F.lit(0).cast("bigint"), "leaf": F.lit(None).cast("double"), "build": F.lit(True)})
    held, tree_parts, closed, parent = [allowed], [], [], None
    for d in range(max_depth):
        hist = _written(level_histogram(st, allowed, parent), f"{path}/hist/{d}")
        st, nodes, dec = grow_level(st, fits, hist, d, lam, mcw)
        st = _written(st, f"{path}/level/{d}")
        held.append(dec)
        tree_parts.append(nodes)
        closed.append(st.where("node is null"))  # their rows take no part in deeper levels
        st, parent = st.where("node is not null"), (hist, dec)
        if st.isEmpty():
            break
    else:
        st, nodes, leaves = close_tree(st, fits, max_depth, lam)
        held.append(leaves)
        tree_parts.append(nodes)
        closed.append(st)
    whole, trees = closed[0], tree_parts[0]  # max_depth + 1 parts at most, whatever the round
    for x in closed[1:]:
        whole = whole.unionByName(x)
    for x in tree_parts[1:]:
        trees = trees.unionByName(x)
    trees.write.mode("overwrite").parquet(f"{path}/trees/round={rnd}")
    state = _written(
        whole.select("fit_id", "study", "row_id", "y", "bins", "subsample", (F.col("margin") + F.coalesce(F.col("leaf"), F.lit(0.0))).alias("margin")), f"{path}/state/{rnd % 2}"
    )
    if wanted:
        asked = fits.where(F.array_contains("rounds", rnd)).select("fit_id")
        state.join(asked, "fit_id", "left_semi").select("fit_id", "study", "row_id", "y", "margin").write.mode("overwrite").parquet(f"{path}/preds/nrounds={rnd}")
    for x in held:
        x.unpersist()


def select_best(aucs: DataFrame, key: str = "study") -> DataFrame:
    """Best grid row per study by training AUC; the first grid_id wins ties (strict >)."""
    w = Window.partitionBy(key).orderBy(F.col("auc").desc_nulls_last(), F.col("grid_id"))
    return aucs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def out_of_fold(rows: DataFrame, grid_values: dict, k: int = 5, max_bins: int | None = None, seed: int = 135, **how) -> DataFrame:
    """Margin of every pooled row under the models that did not see it, for every grid row.

    Folds are stratified by class (:func:`compare.stratified_folds`).  The
    training set of fold f is every row of another fold: each row is
    exploded into the k - 1 training sets it belongs to and the fold takes
    the place of the study in the fit key, so all k x grid fits train
    together.  Held-out rows are scored only by their own fold's models and
    the margin after each requested round count is read off the per-tree
    leaves.  ``row_id`` is to tell the pooled rows apart.
    Output: fold, grid_id, row_id, label, margin.
    """
    from . import trees as TR
    from .compare import stratified_folds

    fo = stratified_folds(rows, k, seed=seed)
    train = fo.select(
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))).alias("study"),
        "row_id", "features", "y",
    )
    trees, _, fits = fit_boosted(train, grid_values, max_bins, **how)
    per_fold = fits.groupBy("study").agg(F.collect_list("fit_id").alias("models"))
    held = fo.select(F.col("fold").alias("study"), "row_id", "features", "y").join(per_fold, "study")
    leaves = TR.score_models(trees, held, ids=["study", "row_id", "y"], per_tree=True)
    nr = sorted(int(n) for n in grid_values["nrounds"])
    marg = leaves.groupBy("study", "row_id", "y", "model").agg(
        *[F.sum(F.when(F.col("tree") < n, F.col("leaf"))).alias(f"m{n}") for n in nr]
    )
    long = marg.select(
        "study", "row_id", "y", "model",
        F.explode(F.array(*[F.struct(F.lit(n).alias("nrounds"), F.col(f"m{n}").alias("margin")) for n in nr])).alias("x"),
    )
    order = [int(n) for n in grid_values["nrounds"]]
    pos = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("x.nrounds"))
    return long.join(fits.select(F.col("fit_id").alias("model"), "fit_no"), "model").select(
        F.col("study").alias("fold"),
        ((F.col("fit_no") - 1) * len(order) + pos).cast("int").alias("grid_id"),
        "row_id",
        F.col("y").cast("int").alias("label"),
        F.col("x.margin").alias("margin"),
    )


def cv_aucs(oof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``aucs(fold, grid_id, auc)`` of :func:`out_of_fold` rows (margins equal to 1e-9 tie) and the mean per grid row ``(grid_id, n_folds, mean_auc)``."""
    from . import roc

    p = oof.select("fold", "grid_id", "label", F.round("margin", 9).alias("score"))
    aucs = roc.auc(p, keys=["fold", "grid_id"]).select("fold", "grid_id", "auc")
    return aucs, aucs.groupBy("grid_id").agg(F.count("auc").alias("n_folds"), F.avg("auc").alias("mean_auc"))


def cross_validate(rows: DataFrame, grid_values: dict, k: int = 5, max_bins: int | None = None, seed: int = 135):
    """k-fold CV of the grid on pooled rows (the centralised model): :func:`cv_aucs` of :func:`out_of_fold`."""
    return cv_aucs(out_of_fold(rows, grid_values, k, max_bins, seed))


def chosen_fits(best: DataFrame, grid_values: dict, use_gamma: bool = True) -> DataFrame:
    """The fits that ``best(study, grid_id)`` names: one per study, with the parameters and rounds of its grid row.

    They are fits of their own (``<study>:final``): their sampling draws are not those of the search.  The
    chosen rows meet the grid inside the plan; the driver does not see them.
    """
    one = best.sparkSession.range(1).select(F.lit(0).alias("_one"))
    grid = param_grid(one, grid_values).drop("_one")
    names = [k for k in grid_values if k != "nrounds"]
    f = best.select("study", "grid_id").join(F.broadcast(grid), "grid_id")  # as many rows as the grid has
    if not use_gamma:
        f = f.withColumn("gamma", F.lit(0.0))
    return f.select(
        "study", F.concat_ws(":", F.col("study").cast("string"), F.lit("final")).alias("fit_id"), F.lit(1).alias("fit_no"), *names, F.array("nrounds").alias("rounds"), "grid_id"
    )


def refit(rows: DataFrame, best: DataFrame, grid_values: dict, max_bins: int | None = None, use_gamma: bool = True, **how):
    """Final fit of every study with its chosen grid row; results as :func:`train_fits`, where ``fits`` also has ``grid_id``."""
    return train_fits(rows, chosen_fits(best, grid_values, use_gamma), max_bins, **how)


POOLED = "pooled"


def pooled(rows: DataFrame) -> DataFrame:
    """All studies' rows as those of one study; ``row_id`` becomes ``<study>:<row_id>``."""
    return rows.select(F.lit(POOLED).alias("study"), F.concat_ws(":", F.col("study").cast("string"), F.col("row_id").cast("string")).alias("row_id"), "features", "y")


def cv_final(rows: DataFrame, mean: DataFrame, grid_values: dict, max_bins: int | None = None, **how):
    """The centralised model: the grid row with the best mean CV AUC, fitted on all pooled rows (see :func:`train_fits`)."""
    best = cv_select(mean).select(F.lit(POOLED).alias("study"), "grid_id")
    return refit(pooled(rows), best, grid_values, max_bins, **how)


def cv_select(mean: DataFrame) -> DataFrame:
    """Grid row with the highest mean CV AUC; the first grid_id wins ties (means of equal AUCs differ by 1e-16)."""
    rank = F.struct(F.round(F.coalesce("mean_auc", F.lit(-1.0)), 12), -F.col("grid_id"))
    return mean.agg(F.max_by(F.struct(*mean.columns), rank).alias("m")).select("m.*")
