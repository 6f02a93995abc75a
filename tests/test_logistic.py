"""Logistic regression: coefficients and probabilities against Newton in numpy; groups without a maximum."""

import numpy as np
import pytest

from sigspark.operators import logistic as L

SCHEMA = "study string, x double, y int"


def newton(x, y, steps=100):
    X, b = np.column_stack([np.ones(len(x)), (x - x.mean()) / x.std()]), np.zeros(2)
    ll = -np.inf
    for _ in range(steps):
        eta = X @ b
        p = 1 / (1 + np.exp(-eta))
        d = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]), X.T @ (y - p))
        t = 1.0
        while True:
            new = b + t * d
            e = X @ new
            ll_new = (y * e - np.logaddexp(0, e)).sum()
            if ll_new >= ll - abs(ll) * 1e-15 or t < 1e-9:
                break
            t /= 2
        b, ll = new, ll_new
    return b[0] - b[1] * x.mean() / x.std(), b[1] / x.std()


def run(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema)
    model = L.fit(df, **kw).checkpoint()
    return {r.study: r for r in model.collect()}, L.predict(df, model).collect()


def test_converges_to_newton(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for s, (scale, shift, slope) in {"a": (1, 0, 1.5), "b": (1000, 5e5, -0.7), "c": (1e-4, 0, 3.0), "d": (1, 0, 12.0)}.items():
        z = rng.normal(size=200)
        y = (rng.random(200) < 1 / (1 + np.exp(-(0.4 + slope * z)))).astype(int)
        x = np.round(shift + scale * z, 8)
        want[s] = newton(x, y)
        rows += [(s, float(a), int(b)) for a, b in zip(x, y, strict=True)]
    got, probs = run(spark, rows + [("a", None, 1), ("a", 1.0, None), ("a", float("nan"), 0), ("a", 2.0, 7)])
    for s, (b0, b1) in want.items():
        assert got[s].status == "fitted" and got[s].n == 200
        assert (got[s].b0, got[s].b1) == pytest.approx((b0, b1), rel=1e-8)
    p = [(r.prob, 1 / (1 + np.exp(-(want[r.study][0] + want[r.study][1] * r.x)))) for r in probs if r.x is not None and not np.isnan(r.x)]
    assert max(abs(a - b) for a, b in p) < 1e-8
    assert sum(r.prob is None for r in probs) == 2 and len(probs) == 804


@pytest.mark.parametrize(
    "points,status,want",
    [
        ([(1, 0), (2, 0), (3, 1), (4, 1)], "separated", {1: 0, 2: 0, 3: 1, 4: 1}),
        ([(1, 1), (2, 1), (3, 0), (4, 0)], "separated", {1: 1, 2: 1, 3: 0, 4: 0}),
        ([(1, 0), (2, 0), (2, 1), (2, 1), (2, 1), (5, 1)], "separated", {1: 0, 2: 0.75, 5: 1}),
        ([(1, 0), (1, 1), (4, 1)], "separated", {1: 0.5, 4: 1}),
        ([(1, 1), (2, 1)], "one class", {1: 1, 2: 1}),
        ([(1, 0), (2, 0)], "one class", {1: 0, 2: 0}),
        ([(3, 0), (3, 1), (3, 1), (3, 1)], "constant", {3: 0.75}),
    ],
)
def test_groups_without_a_maximum(spark, points, status, want):
    got, probs = run(spark, [(None, float(x), y) for x, y in points])
    assert got[None].status == status and got[None].b1 is None
    assert (got[None].b0 is None) == (status != "constant")
    if status == "constant":
        assert got[None].b0 == pytest.approx(np.log(3))
    assert {r.x: r.prob for r in probs} == pytest.approx(want)


def test_new_rows_of_a_separated_group(spark):
    df = spark.createDataFrame([("s", 1.0, 0), ("s", 4.0, 1)], SCHEMA)
    new = spark.createDataFrame([("s", x, None) for x in (0.0, 2.0, 2.4, 2.6, 9.0, None)] + [("t", 1.0, None)], SCHEMA)
    got = {(r.study, r.x): r.prob for r in L.predict(new, L.fit(df)).collect()}
    assert got == {("s", 0.0): 0.0, ("s", 2.0): 0.0, ("s", 2.4): 0.0, ("s", 2.6): 1.0, ("s", 9.0): 1.0, ("s", None): None, ("t", 1.0): None}


def test_a_steep_group_needs_its_steps_halved(spark):
    x = np.concatenate([np.linspace(-1, 1, 40), [30.0]])
    y = np.concatenate([np.linspace(-1, 1, 40) > 0.02, [False]]).astype(int)
    y[18], y[22] = 1, 0
    got, _ = run(spark, [("s", float(a), int(b)) for a, b in zip(x, y, strict=True)])
    assert got["s"].status == "fitted"
    assert (got["s"].b0, got["s"].b1) == pytest.approx(newton(x, y), rel=1e-7)


def test_converged_groups_leave_the_job(spark, monkeypatch):
    seen, real = [], L._pass

    def spy(d, at, keys):
        seen.append(at.count())
        return real(d, at, keys)

    monkeypatch.setattr(L, "_pass", spy)
    rng = np.random.default_rng(3)
    rows = [("easy", float(v), int(rng.random() < 0.5)) for v in rng.normal(size=100)]
    rows += [("hard", float(v), int(v + 0.15 * rng.normal() > 0)) for v in rng.normal(size=100)]
    got, _ = run(spark, rows)
    assert seen[0] == 2 and seen[-1] == 1 and got["easy"].passes < got["hard"].passes <= len(seen)


def test_empty(spark):
    got, probs = run(spark, [])
    assert got == {} and probs == []
