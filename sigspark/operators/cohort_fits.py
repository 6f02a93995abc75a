"""Boosted trees of small cohorts: every fit of a cohort is grown inside one task.

The same algorithm as :mod:`sigspark.operators.boost`, draw for draw and tie for
tie, for cohorts whose binned rows fit in a task (CELLS rows x features at most,
measured by the caller).  A cohort's rows are dealt to as many tasks as it has chunks
of fits; a task bins them once and grows its fits one after the other, a level of
all nodes and features at a time.  So a whole grid over all cohorts is one job
with one shuffle, and cohorts are never pooled: a group holds rows of one study only.

Per feature, rows are sorted by bin once.  A level sorts them (stably) by node, so running
sums along them, less the sum where the node begins, are the node's sums up
to each bin; the last row of a bin's run is a candidate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (rows x features) of the largest cohort that is fitted inside a task, and fits of a task.
CELLS, CHUNK_FITS = 1 << 18, 16
#: A child may lack so much of the least weight: sums of the same rows in another order differ by less.
SLACK = 1e-9

NODE_SCHEMA = (
    "tree int, node long, depth int, feature int, bin int, threshold double, default_left boolean, `left` long, `right` long, "
    "leaf_value double, gain double, cover double"
)


def uniform(*parts: object) -> float:
    """:func:`sigspark.functions.md5_uniform` of the parts (None is left out, as there)."""
    return int(hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:8], 16) / 4294967296.0


@dataclass
class Cohort:
    """Binned rows of one study."""

    y: np.ndarray
    ids: list[str | None]  # as text, for the draws
    place: np.ndarray  # (features, rows): the bin's place among the feature's bins; `missing` where there is no value
    order: np.ndarray  # (features, rows): rows by place
    names: list[np.ndarray]  # bin of each place
    cuts: list[np.ndarray]  # midpoint after each place

    @classmethod
    def of(cls, features: pa.ListArray, y: np.ndarray, ids: list[str | None], n_features: int, max_bins: int | None) -> Cohort:
        rows = len(y)
        values, known = np.zeros((n_features, rows)), np.zeros((n_features, rows), bool)
        for r, v in enumerate(features.to_pylist()):
            for f, x in enumerate(v or ()):
                if x is not None:
                    values[f, r], known[f, r] = x, True
        place, names, cuts = np.full((n_features, rows), rows, np.int32), [], []
        for f in range(n_features):
            distinct, rank = np.unique(values[f, known[f]], return_inverse=True)
            m = max(1, len(distinct))
            name = np.arange(len(distinct)) if max_bins is None else np.floor(np.arange(len(distinct)) * max_bins / m).astype(int)
            bins, of = np.unique(name, return_inverse=True)
            place[f, known[f]] = of[rank]
            last = np.append(np.flatnonzero(np.diff(of)), len(of) - 1)[: len(bins)]  # place of each bin's largest value
            cut = np.full(len(bins), np.nan)
            cut[:-1] = (distinct[last[:-1]] + distinct[last[:-1] + 1]) / 2 if len(bins) > 1 else cut[:-1]
            names.append(bins)
            cuts.append(cut)
        return cls(y, ids, place, np.argsort(place, axis=1, kind="stable").astype(np.int32), names, cuts)

    @property
    def missing(self) -> int:
        return len(self.y)


@dataclass(frozen=True)
class Fit:
    name: str
    eta: float
    max_depth: int
    gamma: float
    colsample_bytree: float
    subsample: float


def best_splits(c: Cohort, features: np.ndarray, rows: np.ndarray, of: np.ndarray, g: np.ndarray, h: np.ndarray, gt: np.ndarray, ht: np.ndarray, lam: float, mcw: float):
    """For each node (rows' ``of``): gain (-inf without a valid split), feature, place, and whether missing values go left."""
    nodes, m = len(gt), int(rows.sum())
    order = c.order[features]
    order = order[rows[order]].reshape(len(features), m)
    if nodes > 1:  # bring the rows of a node together, still by place
        order = np.take_along_axis(order, np.argsort(of[order].astype(np.uint16 if nodes < 1 << 16 else np.int64), axis=1, kind="stable"), 1)
    size = np.bincount(of[rows], minlength=nodes)  # the same runs of nodes for every feature
    begin = np.cumsum(size) - size
    node = np.repeat(np.arange(nodes), size)
    at = c.place[features[:, None], order]
    known = at < c.missing

    def sums(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.cumsum(np.where(known, v[order], 0.0), axis=1)
        before = np.where(begin > 0, run[:, begin - 1], 0.0)
        return run - before[:, node], run[:, begin + size - 1] - before

    gk, gs = sums(g)
    hk, hs = sums(h)
    last = np.zeros_like(known)  # the last row of a bin's run with a known value after it in the node
    last[:, :-1] = known[:, :-1] & known[:, 1:] & (at[:, 1:] > at[:, :-1]) & (node[1:] == node[:-1])
    total = gt * gt / (ht + lam)

    def gain(gl: np.ndarray, hl: np.ndarray) -> np.ndarray:
        gr, hr = gt[node] - gl, ht[node] - hl
        x = np.round(gl * gl / (hl + lam) + gr * gr / (hr + lam) - total[node], 9)
        return np.where(last & (hl >= mcw - SLACK) & (hr >= mcw - SLACK), x, -np.inf)

    left, right = gain(gk + (gt - gs)[:, node], hk + (ht - hs)[:, node]), gain(gk, hk)
    both = np.maximum(left, right)
    top = np.maximum.reduceat(both, begin, axis=1)
    best = top.max(0)
    f = (top == best).argmax(0)  # the first feature, then the first bin, then to the left
    place, to_left = np.zeros(nodes, np.int64), np.zeros(nodes, bool)
    for k in np.flatnonzero(best > -np.inf):
        i = begin[k] + int((both[f[k], begin[k] : begin[k] + size[k]] == best[k]).argmax())
        place[k], to_left[k] = at[f[k], i], left[f[k], i] == best[k]
    return best, features[f], place, to_left


def grow(c: Cohort, fit: Fit, rounds: int, wanted: list[int], lam: float, mcw: float, min_gain: float, emit: Callable[..., None]) -> dict[int, np.ndarray]:
    """Grows ``rounds`` trees, hands each node to ``emit`` and returns the margins after the wanted rounds."""
    n, n_features = len(c.y), len(c.names)
    margin, out = np.zeros(n), {}
    n_cols = max(1, math.floor(fit.colsample_bytree * n_features))
    for rnd in range(1, rounds + 1):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - c.y, p * (1.0 - p)
        features = np.arange(n_features)
        if n_cols < n_features:
            features = np.sort(sorted(range(n_features), key=lambda f: (uniform(fit.name, rnd, f), f))[:n_cols])
        keep = np.ones(n, bool)
        if fit.subsample < 1:
            keep = np.array([uniform(fit.name, rnd, i) < fit.subsample for i in c.ids])
        node, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for depth in range(fit.max_depth + 1):
            rows = keep & open_
            if not rows.any():
                break
            ids = np.unique(node[rows])
            of = np.searchsorted(ids, node)
            of[~open_] = 0
            gt, ht = (np.bincount(of[rows], v[rows], len(ids)) for v in (g, h))
            gain = np.full(len(ids), -np.inf)
            if depth < fit.max_depth and len(features):
                gain, feature, place, to_left = best_splits(c, features, rows, of, g, h, gt, ht, lam, mcw)
            split = (gain > fit.gamma) & (gain > min_gain)
            leaf = -fit.eta * gt / (ht + lam)
            for k, i in enumerate(ids.tolist()):
                if split[k]:
                    f, b = int(feature[k]), int(place[k])
                    cut = float(c.cuts[f][b])
                    emit(rnd - 1, i, depth, f, int(c.names[f][b]), cut, bool(to_left[k]), 2 * i + 1, 2 * i + 2, None, float(gain[k]), float(ht[k]))
                else:
                    emit(rnd - 1, i, depth, None, None, None, None, None, None, float(leaf[k]), None, float(ht[k]))
            done = open_ & ~split[of]
            margin[done] += leaf[of[done]]
            open_ &= ~done
            r = np.flatnonzero(open_)
            if not len(r):
                break
            k = of[r]
            at = c.place[feature[k], r]
            go_left = np.where(at == c.missing, to_left[k], at <= place[k])
            node[r] = 2 * node[r] + np.where(go_left, 1, 2)
        if rnd in wanted:
            out[rnd] = margin.copy()
    return out


def fit_cohorts(rows: DataFrame, fits: DataFrame, each: int, n_features: int, max_bins: int | None, lam: float, mcw: float, min_gain: float) -> DataFrame:
    """All ``fits`` of every study, ``each`` of them to a task: rows of kind 0 are tree nodes, of kind 1 margins.

    ``rows(study, row_id, features, y)``, ``fits(study, fit_id, fit_no, eta, max_depth, gamma, colsample_bytree, subsample, rounds)``.
    The schema is fit_id, study, kind, NODE_SCHEMA, nrounds, row_id, y, margin.
    """
    types = dict(rows.dtypes)
    schema = f"fit_id string, study {types['study']}, kind int, {NODE_SCHEMA}, nrounds int, row_id {types['row_id']}, y double, margin double"
    chunk = F.expr(f"(fit_no - 1) div {each}").alias("f_chunk")
    dealt = fits.where("study is not null").select(
        F.col("study").alias("f_study"), chunk, "fit_id", "fit_no", "rounds", F.col("max_depth").cast("int").alias("max_depth"),
        *[F.col(c).cast("double").alias(c) for c in ("eta", "gamma", "colsample_bytree", "subsample")],
    )
    chunks = dealt.select("f_study", "f_chunk").distinct()
    cohort = rows.join(chunks, rows["study"] == F.col("f_study")).select(
        "study", F.col("f_chunk").alias("chunk"), "row_id", F.col("row_id").cast("string").alias("rid"), F.col("y").cast("double").alias("y"),
        F.col("features").cast("array<double>").alias("features"),
    )
    nodes_type = pa.schema(
        [("tree", pa.int32()), ("node", pa.int64()), ("depth", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("threshold", pa.float64()), ("default_left", pa.bool_()),
         ("left", pa.int64()), ("right", pa.int64()), ("leaf_value", pa.float64()), ("gain", pa.float64()), ("cover", pa.float64())]
    )

    def run(t: pa.Table, f: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        study, id_type = t.schema.field("study").type, t.schema.field("row_id").type
        margins_type = {"nrounds": pa.int32(), "row_id": id_type, "y": pa.float64(), "margin": pa.float64()}
        parts = []

        def part(fit_id: str, kind: int, n: int, cols: dict) -> None:
            all_types = {x.name: x.type for x in nodes_type} | margins_type
            whole = {k: cols.get(k, pa.nulls(n, ty)) for k, ty in all_types.items()}
            parts.append(pa.table({"fit_id": pa.array([fit_id] * n, pa.string()), "study": pa.repeat(t.column("study")[0], n), "kind": pa.array([kind] * n, pa.int32())} | whole))

        if t.num_rows and f.num_rows:
            y = t.column("y").to_numpy()
            c = Cohort.of(t.column("features"), y, t.column("rid").to_pylist(), n_features, max_bins)
            for r in f.sort_by("fit_no").to_pylist():
                fit = Fit(r["fit_id"], r["eta"], r["max_depth"], r["gamma"], r["colsample_bytree"], r["subsample"])
                nodes: list[tuple] = []
                margins = grow(c, fit, max(r["rounds"]), r["rounds"], lam, mcw, min_gain, lambda *node: nodes.append(node))  # noqa: B023
                cols = list(zip(*nodes, strict=True)) or [()] * len(nodes_type)
                part(fit.name, 0, len(nodes), {x.name: pa.array(v, x.type) for x, v in zip(nodes_type, cols, strict=True)})
                for n, m in margins.items():
                    part(fit.name, 1, len(y), {"nrounds": pa.array(np.full(len(y), n, np.int32)), "row_id": t.column("row_id"), "y": t.column("y"), "margin": pa.array(m)})
        if not parts:
            part("", 0, 0, {"row_id": pa.nulls(0, id_type)})
            parts = [parts[0].set_column(1, "study", pa.nulls(0, study))]
        return pa.concat_tables(parts)

    return cohort.groupBy("study", "chunk").cogroup(dealt.groupBy("f_study", "f_chunk")).applyInArrow(run, schema)
