"""Univariate logistic regression per group, fitted to convergence, with probabilities.

Rows are collapsed to (group, x) counts first, so the iteration reads one row
per distinct value.  A pass evaluates the likelihood at each group's candidate
and gathers five moments; groups whose candidate does not lower
the likelihood take it and get the next Newton step, others halve their step.  Groups that
have converged leave the job: the next pass reads the values of open groups only.
The driver sees the number of open groups, never a row of data.

Not every group has a maximum.  What is returned then is the limit that the
likelihood runs to, and ``status`` says so:

* ``separated``: some value of x parts the classes (the parted value itself may
  hold both); coefficients are NULL, probabilities 0 and 1 on either side
  and the share of ones at the value that both classes have;
* ``one class``: coefficients NULL, probability 0 or 1 for all;
* ``constant``: all x equal; the slope is NULL, the intercept the log odds of the share;
* ``no rows``: no row with both x and y; everything is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, reuse
from .scan import null_safe_join

#: Newton passes at most, and the relative change of both (standardised) coefficients that ends the iteration.
MAX_PASSES, TOLERANCE = 50, 1e-12

#: Models of up to so many groups travel to the rows; beyond that both are shuffled.
MAX_BROADCAST_GROUPS = 100_000


def _collapsed(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One row per (group, x): n rows, of which ``ones`` have y = 1."""
    known = rows.where(F.col(y).isin(0, 1) & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    return known.groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("ones"))


def _groups(c: DataFrame, keys: list[str]) -> DataFrame:
    """Size, mean and spread of each group, and how its classes lie: keys, n, ones, mean, sd, status, gap, up."""
    zeros = F.col("n") - F.col("ones")
    edge = lambda f, part: f(F.when(part > 0, F.col("x")))
    g = c.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"),
        edge(F.min, F.col("ones")).alias("lo1"), edge(F.max, F.col("ones")).alias("hi1"), edge(F.min, zeros).alias("lo0"), edge(F.max, zeros).alias("hi0"),
    )
    up, down = F.col("hi0") <= F.col("lo1"), F.col("hi1") <= F.col("lo0")
    status = (
        F.when((F.col("ones") == 0) | (F.col("ones") == F.col("n")), "one class")
        .when(F.col("low") == F.col("high"), "constant")
        .when(up | down, "separated")
        .otherwise("fitted")
    )
    spread = null_safe_join(c, g.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * (F.col("x") - F.col("mean")) ** 2) / F.sum("n")).alias("sd"))
    out = null_safe_join(g, spread, keys).withColumn("status", status)
    # the ones lie above ``gap0`` and the zeros below ``gap1`` (equal where both classes have that value)
    return out.select(*keys, "n", "ones", "mean", "sd", "status", up.alias("up"), F.when(up, F.col("lo1")).otherwise(F.col("hi1")).alias("edge1"), F.when(up, F.col("hi0")).otherwise(F.col("lo0")).alias("edge0"))


def _pass(d: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """Likelihood, gradient and Hessian of each open group at its candidate (c0, c1)."""
    j = null_safe_join(d, at, keys)
    eta = F.col("c0") + F.col("c1") * F.col("z")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    w = F.col("n") * p * (F.lit(1.0) - p)
    r = F.col("ones") - F.col("n") * p
    # log(1 + e^eta) without overflow
    soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    return j.groupBy(*keys).agg(
        F.sum(F.col("ones") * eta - F.col("n") * soft).alias("ll_c"), F.sum(w).alias("a"), F.sum(w * F.col("z")).alias("b"), F.sum(w * F.col("z") * F.col("z")).alias("c"),
        F.sum(r).alias("g0"), F.sum(r * F.col("z")).alias("g1"),
    )


def fit(rows: DataFrame, x: str = "x", y: str = "y", keys: Sequence[str] = ("study",), passes: int = MAX_PASSES, tol: float = TOLERANCE) -> DataFrame:
    """Logistic regression y ~ x of each group.

    y is 0 or 1; rows without x or y are left out.
    Output: keys, n, ones, status, b0, b1, passes (that the group took; ``fitted`` groups only), edge0, edge1, up (for :func:`predict`).
    A group that has not converged after ``passes`` keeps its best coefficients under the status ``open``.
    """
    keys = list(keys)
    c = reuse(_collapsed(rows, keys, x, y))
    groups = cut_lineage(_groups(c, keys))
    d = null_safe_join(c, groups.where("status = 'fitted'").select(*keys, "mean", "sd"), keys)
    d = reuse(d.select(*keys, "n", "ones", ((F.col("x") - F.col("mean")) / F.col("sd")).alias("z")))
    zero = F.lit(0.0)
    state = groups.where("status = 'fitted'").select(
        *keys, zero.alias("b0"), zero.alias("b1"), F.lit(float("-inf")).alias("ll"), zero.alias("d0"), zero.alias("d1"), F.lit(1.0).alias("t"), F.lit(0).alias("passes"), F.lit(False).alias("done")
    )
    closed = None
    for _ in range(passes):
        candidate = state.withColumns({"c0": F.col("b0") + F.col("t") * F.col("d0"), "c1": F.col("b1") + F.col("t") * F.col("d1")})
        m = null_safe_join(candidate, _pass(d, candidate.select(*keys, "c0", "c1"), keys), keys)
        better = F.col("ll_c") >= F.col("ll") - F.abs(F.col("ll")) * 1e-14
        det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
        n0, n1 = F.try_divide(F.col("c") * F.col("g0") - F.col("b") * F.col("g1"), det), F.try_divide(F.col("a") * F.col("g1") - F.col("b") * F.col("g0"), det)
        small = (F.abs(n0) <= tol * (F.abs("c0") + 1)) & (F.abs(n1) <= tol * (F.abs("c1") + 1))
        keep = lambda new, old: F.when(better, new).otherwise(F.col(old)).alias(old)
        state = m.select(
            *keys, keep(F.col("c0"), "b0"), keep(F.col("c1"), "b1"), keep(F.col("ll_c"), "ll"), keep(F.coalesce(n0, zero), "d0"), keep(F.coalesce(n1, zero), "d1"),
            F.when(better, F.lit(1.0)).otherwise(F.col("t") / 2).alias("t"), (F.col("passes") + 1).alias("passes"),
            F.coalesce((better & small) | (~better & (F.col("t") < 1e-6)) | (det <= 0), F.lit(True)).alias("done"),
        )
        state = cut_lineage(state)  # one row a group
        finished = state.where("done")
        closed = finished if closed is None else closed.unionByName(finished)
        state = state.where("not done")
        if state.isEmpty():
            break
    found = closed.unionByName(state) if closed is not None else state
    out = null_safe_join(groups, found.select(*keys, "b0", "b1", "passes", "done"), keys, "left")
    slope = F.col("b1") / F.col("sd")
    share = F.col("ones") / F.col("n")
    return out.select(
        *keys, "n", "ones", F.when((F.col("status") == "fitted") & ~F.col("done"), "open").otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "constant", F.log(share / (1 - share))).otherwise(F.col("b0") - slope * F.col("mean")).alias("b0"), slope.alias("b1"), "passes", "edge0", "edge1", "up",
    )


def predict(rows: DataFrame, model: DataFrame, x: str = "x", y: str = "y", keys: Sequence[str] = ("study",), out_col: str = "prob") -> DataFrame:
    """``rows`` with the probability of y = 1 under the model of their group; NULL without x or without a model.

    ``y`` is read for the share of ones at the edge of separated groups only.
    """
    keys = list(keys)
    share = null_safe_join(_collapsed(rows, keys, x, y), model.where("status = 'separated' and edge0 = edge1").select(*keys, "edge0"), keys)
    share = share.where(F.col("x") == F.col("edge0")).select(*keys, (F.col("ones") / F.col("n")).alias("_share"))
    m = null_safe_join(model.select(*keys, F.col("n").alias("_n"), F.col("ones").alias("_ones"), *[F.col(c).alias(f"_{c}") for c in ("status", "b0", "b1", "edge0", "edge1", "up")]), share, keys, "left")
    m = cut_lineage(m)  # one row a group; the rows stay where they lie
    j = null_safe_join(rows, F.broadcast(m) if m.count() <= MAX_BROADCAST_GROUPS else m, keys, "left")
    v = F.col(x).cast("double")
    at_edge = (v == F.col("_edge0")) & (v == F.col("_edge1"))
    above = F.when(F.col("_up"), v >= F.col("_edge1")).otherwise(v <= F.col("_edge1"))
    below = F.when(F.col("_up"), v <= F.col("_edge0")).otherwise(v >= F.col("_edge0"))
    # between the edges there was no row to fit; the middle of the gap parts it
    nearer = F.abs(v - F.col("_edge1")) <= F.abs(v - F.col("_edge0"))
    parted = F.when(at_edge, F.col("_share")).when(above, 1.0).when(below, 0.0).otherwise(F.when(nearer, 1.0).otherwise(0.0))
    p = (
        F.when(v.isNull() | F.isnan(v), None)
        .when(F.col("_status") == "separated", parted)
        .when(F.col("_status").isin("one class", "constant"), F.col("_ones") / F.col("_n"))
        .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_b0") + F.col("_b1") * v))))
    )
    return j.select(*rows.columns, p.alias(out_col))
