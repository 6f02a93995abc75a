"""Scoring of tree tables in Arrow batches.

A forest is five flat arrays over all nodes of all trees; a batch of rows walks
every tree at once, a level at a time, until all have reached a leaf.  The arrays travel to the tasks in
parts of PART_NODES nodes at most (measured first), cut between trees, so neither
a task's memory nor a broadcast follows the number of models.  One part needs no shuffle;
with several, a row's partial margins are added in one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, reuse

#: Nodes of a broadcast part (about 45 bytes each; a tree is never cut), and (row, tree) pairs walked at once.
PART_NODES, PAIRS = 2_000_000, 1 << 20
NODE_COLUMNS = ("feature", "threshold", "default_left", "left", "right", "leaf_value")


class Forest:
    """The trees of a table (model, tree, node, NODE_COLUMNS), sorted by model and tree; a tree's root is its lowest node."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("model", "ascending"), ("tree", "ascending"), ("node", "ascending")]).combine_chunks()
        whole = lambda c, fill: pc.fill_null(t.column(c), fill).to_numpy()
        n = t.num_rows
        codes = t.column("model").dictionary_encode().combine_chunks() if n else pa.array([], pa.string()).dictionary_encode()
        self.models = codes.dictionary
        model, tree, node = codes.indices.to_numpy(), whole("tree", 0), whole("node", 0).astype(np.int64)
        first = np.flatnonzero(np.append(True, (model[1:] != model[:-1]) | (tree[1:] != tree[:-1]))) if n else np.zeros(0, np.int64)
        self.root, self.model, self.tree = first, model[first], tree[first]
        of = np.cumsum(np.isin(np.arange(n), first)) - 1
        self.feature = whole("feature", -1).astype(np.int32)
        self.threshold, self.leaf = whole("threshold", 0.0), whole("leaf_value", 0.0)
        self.missing_left = whole("default_left", False)
        # children as places: nodes are sorted within their tree
        span = int(node.max()) + 2 if n else 1
        key = of * span + node
        inner = self.feature >= 0
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for side, out in (("left", self.left), ("right", self.right)):
            child = whole(side, 0).astype(np.int64)[inner]
            place = np.searchsorted(key, of[inner] * span + np.minimum(child, span - 1))
            if (place >= n).any() or (key[place] != of[inner] * span + child).any():
                raise ValueError(f"a node's {side} child is not in its tree")
            out[inner] = place
        self.rank = np.arange(n)

    def leaves(self, x: np.ndarray, known: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """Value of the leaf that each row (first axis) reaches in each of the ``trees``; a feature beyond the row's is missing."""
        rows, width = x.shape
        at = np.broadcast_to(self.root[trees], (rows, len(trees))).ravel().copy()
        row = np.repeat(np.arange(rows), len(trees))
        open_ = np.flatnonzero(self.feature[at] >= 0)
        for _ in range(len(self.rank) + 1):
            if not len(open_):
                return self.leaf[at].reshape(rows, len(trees))
            a, r = at[open_], row[open_]
            f = self.feature[a]
            there = f < width
            f = np.where(there, f, 0)
            has = there & (known[r, f] if width else False)
            left = np.where(has, x[r, f] < self.threshold[a] if width else False, self.missing_left[a])
            at[open_] = np.where(left, self.left[a], self.right[a])
            open_ = open_[self.feature[at[open_]] >= 0]
        raise ValueError("the nodes of a tree form a ring")


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are known) of a column of lists; a row shorter than the longest has missing values at its end."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    x, known = (np.zeros((len(col), int(size.max(initial=0))), t) for t in (float, bool))
    inside = np.arange(x.shape[1]) < size[:, None]
    x[inside], known[inside] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(flat).to_numpy(zero_copy_only=False)
    return x, known


def _scored(rows: DataFrame, part: pa.Table, ids: list[str], by_row: bool, per_tree: bool) -> DataFrame:
    """ids, model and margin (or tree and leaf) of every row under the trees of ``part``; ``by_row``: under the models in its column ``_models`` only."""
    schema = rows.select(*ids).withColumn("model", F.lit(""))
    schema = (schema.withColumns({"tree": F.lit(0), "leaf": F.lit(0.0)}) if per_tree else schema.withColumn("margin", F.lit(0.0))).schema
    names = schema.names
    shared = rows.sparkSession.sparkContext.broadcast(part)
    frame = rows.select(*ids, *(["_models"] if by_row else []), F.col("features").cast("array<double>").alias("_features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(shared.value)
        step = max(1, PAIRS // max(1, len(forest.root)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                x, known = _matrix(b.column(b.num_columns - 1))
                for m, name in enumerate(forest.models.to_pylist()):
                    trees, at = np.flatnonzero(forest.model == m), np.arange(b.num_rows)
                    if by_row:
                        at = np.flatnonzero([name in (v or ()) for v in b.column(len(ids)).to_pylist()])
                    if not len(at):
                        continue
                    leaf = forest.leaves(x[at], known[at], trees)
                    head = [c.take(pa.array(np.repeat(at, len(trees)) if per_tree else at)) for c in b.columns[: len(ids)]]
                    n = len(at) * (len(trees) if per_tree else 1)
                    values = [pa.array(np.tile(forest.tree[trees], len(at)).astype(np.int32)), pa.array(leaf.ravel())] if per_tree else [pa.array(leaf.sum(1))]
                    yield pa.RecordBatch.from_arrays([*head, pa.array([name] * n, pa.string()), *values], names=names)

    return frame.mapInArrow(run, schema)


def score(rows: DataFrame, trees: DataFrame, ids: Sequence[str], models: Sequence[str] | None = None, per_tree: bool = False) -> DataFrame:
    """ids, model, margin (``per_tree``: ids, model, tree, leaf) of every row under every model; see :func:`trees.score_models`."""
    ids = list(ids)
    by_row = "models" in rows.columns
    t = trees.select("model", "tree", F.col("node").cast("long").alias("node"), *[F.col(c).cast(ty).alias(c) for c, ty in zip(NODE_COLUMNS, ("int", "double", "boolean", "long", "long", "double"), strict=True)])
    if models is not None and not by_row:
        t = t.where(F.col("model").isin(list(models)))
    t = reuse(t)
    rows = rows.withColumn("_models", F.col("models")) if by_row else rows
    if t.count() <= PART_NODES:
        return _scored(rows, t.toArrow(), ids, by_row, per_tree)
    # one row a tree: their running sum cuts the forest between trees
    before = F.sum("n").over(Window.orderBy("model", "tree")) - F.col("n")
    cut = t.groupBy("model", "tree").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    cut = reuse(cut.select("model", "tree", F.expr(f"before div {PART_NODES}").alias("part")))
    # rows are read once a part: a number tells equal ones apart when their margins are added
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    out = None
    for (p,) in sorted(cut.select("part").distinct().collect()):
        part = t.join(cut.where(F.col("part") == p).drop("part"), ["model", "tree"], "left_semi").toArrow()
        one = _scored(rows, part, ["_row", *ids], by_row, per_tree)
        out = one if out is None else out.unionByName(one)
    if per_tree:
        return out.drop("_row")
    return out.groupBy("_row", *ids, "model").agg(F.sum("margin").alias("margin")).drop("_row")
