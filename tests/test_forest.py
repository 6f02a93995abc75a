"""Scoring in Arrow batches against a walk node by node, for one part of the forest and for many."""

import math

import numpy as np
import pytest

from sigspark.operators import forest as FO
from sigspark.operators import trees as TR

TREES = "model string, tree int, node long, feature int, threshold double, default_left boolean, `left` long, `right` long, leaf_value double"
ROWS = "study long, row_id long, features array<double>"


def random_trees(rng, models=3, trees=4, depth=4, n_features=5):
    out = []
    for m in range(models):
        for t in range(trees):

            def grow(node, d):
                if d == depth or (d and rng.random() < 0.25):
                    out.append((f"m{m}", t, node, None, None, None, None, None, float(rng.normal())))
                    return
                out.append((f"m{m}", t, node, int(rng.integers(0, n_features)), float(np.round(rng.normal(), 1)), bool(rng.integers(0, 2)), 2 * node + 1, 2 * node + 2, None))
                grow(2 * node + 1, d + 1)
                grow(2 * node + 2, d + 1)

            grow(0, 0)
    return out


def random_rows(rng, n=60, n_features=5):
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0]
    rows = [(i % 2, i, [odd[rng.integers(0, 6)] if rng.random() < 0.3 else float(np.round(rng.normal(), 1)) for _ in range(n_features)]) for i in range(n)]
    return [*rows, (0, n, []), (0, n + 1, None), (1, n + 2, [0.3]), (1, n + 2, [0.3])]


def walk(nodes, x):
    at = nodes[0]
    while at[3] is not None:
        v = x[at[3]] if x is not None and at[3] < len(x) else None
        left = at[5] if v is None else (not math.isnan(v) and v < at[4])
        at = nodes[at[6] if left else at[7]]
    return at[8]


def leaves(trees, rows):
    by = {}
    for t in trees:
        by.setdefault((t[0], t[1]), {})[t[2]] = t
    return sorted((s, i, m, t, walk(nodes, x)) for s, i, x in rows for (m, t), nodes in by.items())


@pytest.mark.parametrize("part,pairs", [(2_000_000, 1 << 20), (40, 7), (1, 1)])
def test_any_parts(spark, monkeypatch, part, pairs):
    monkeypatch.setattr(FO, "PART_NODES", part)
    monkeypatch.setattr(FO, "PAIRS", pairs)
    rng = np.random.default_rng(part)
    trees, rows = random_trees(rng), random_rows(rng)
    t, r = spark.createDataFrame(trees, TREES).repartition(3), spark.createDataFrame(rows, ROWS).repartition(2)
    want = leaves(trees, rows)
    got = sorted(map(tuple, TR.score_models(t, r, per_tree=True).select("study", "row_id", "model", "tree", "leaf").collect()))
    assert got == want
    margins = {}
    for s, i, m, k, v in want:
        margins.setdefault((s, i, m), {}).setdefault(k, []).append(v)
    found = TR.score_models(t, r).collect()
    assert len(found) == 3 * len(rows)
    for x in found:
        whole = sum(v[0] for v in margins[x.study, x.row_id, x.model].values())
        assert x.margin == pytest.approx(whole, abs=1e-12) and x.prob == pytest.approx(1 / (1 + math.exp(-whole)), abs=1e-12)


def test_chosen_models_and_models_of_a_row(spark):
    rng = np.random.default_rng(4)
    trees, rows = random_trees(rng), random_rows(rng, 9)
    t, r = spark.createDataFrame(trees, TREES), spark.createDataFrame(rows, ROWS)
    some = TR.score_models(t, r, models=["m1", "none"]).collect()
    assert {x.model for x in some} == {"m1"} and len(some) == len(rows)
    own = TR.score_models(t, r.selectExpr("*", "if(row_id = 3, array('m0', 'm2'), if(row_id = 4, null, array('m1'))) as models")).collect()
    assert {(x.row_id, x.model) for x in own} == {(3, "m0"), (3, "m2")} | {(i, "m1") for _, i, _ in rows if i not in (3, 4)}


def test_broken_trees_and_empty_tables(spark):
    rows = spark.createDataFrame([(0, 1, [1.0])], ROWS)
    lost = [("m", 0, 0, 0, 0.5, True, 1, 2, None), ("m", 0, 1, None, None, None, None, None, 1.0)]
    with pytest.raises(Exception, match="right child is not in its tree"):
        TR.score_models(spark.createDataFrame(lost, TREES), rows).collect()
    ring = [("m", 0, 0, 0, 0.5, True, 0, 0, None)]
    with pytest.raises(Exception, match="form a ring"):
        TR.score_models(spark.createDataFrame(ring, TREES), rows).collect()
    trees = spark.createDataFrame(random_trees(np.random.default_rng(1)), TREES)
    assert TR.score_models(trees, rows.limit(0)).count() == 0 and TR.score_models(trees.limit(0), rows).count() == 0


def test_rows_do_not_move_for_one_part(spark):
    rng = np.random.default_rng(2)
    plan = TR.score_models(spark.createDataFrame(random_trees(rng), TREES), spark.createDataFrame(random_rows(rng), ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
