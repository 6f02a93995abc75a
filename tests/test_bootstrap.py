"""Bootstrap: draws against plain Python, cells and spans of any size, distribution of the counts."""

import hashlib

import duckdb
import numpy as np
import pytest

from sigspark.operators import bootstrap as B
from sigspark.plans import boost_sql as BS

M32 = 0xFFFFFFFF


def u_plain(b0, b1, a, j):
    def mix(x):
        for _ in range(2):
            x = ((x >> 16 ^ x) * 73244475) & M32
        return x >> 16 ^ x

    x = mix((b0 + a * 2654435761 + j * 2246822519) & M32)
    y = (b1 + a * 3266489917 + j * 668265263) & M32
    return (mix((x + y) & M32) * (1 << 21) + (mix(x ^ y) >> 11)) / 2**53


def base(*key):
    h = hashlib.md5("|".join(map(str, key)).encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16)


def brute(rows, keys, reps, seed, cell, fan):
    """AUC of every replicate of one group, draw by draw; rows are (score, label)."""
    scores = sorted({s for s, _ in rows})
    below = {s: sum(x < s for x, _ in rows) for s in scores}
    cell_of = {s: below[s] // cell for s in scores}
    out = []
    levels, spans = 0, max(cell_of.values()) + 1
    widest = spans
    while spans > 1:
        levels, spans = levels + 1, -(-spans // fan)
    for rep in range(1, reps + 1):
        weights = {}
        for y in (1, 0):
            mine = sorted(s for s, lab in rows if lab == y)
            counts = {0: len(mine)}
            for level in range(levels, 0, -1):
                new = {}
                for span, n in counts.items():
                    inside = [s for s in mine if cell_of[s] // fan**level == span]
                    kids = [cell_of[s] // fan ** (level - 1) for s in inside]
                    b = base(*keys, y, seed, level, span)
                    for j in range(n):
                        k = kids[0] if len(set(kids)) == 1 else kids[int(u_plain(*b, rep, j) * len(kids))]
                        new[k] = new.get(k, 0) + 1
                counts = new
            for c, n in counts.items():
                inside = [s for s in mine if cell_of[s] == c]
                b = base(*keys, y, seed, 0, c)
                for j in range(n):
                    s = inside[int(u_plain(*b, rep, j) * len(inside))]
                    weights[s, y] = weights.get((s, y), 0) + 1
        p, q = ({s: w for (s, y), w in weights.items() if y == k} for k in (1, 0))
        pairs = sum(w * v * (1.0 if s > t else 0.5 if s == t else 0.0) for s, w in p.items() for t, v in q.items())
        out.append(pairs / (sum(p.values()) * sum(q.values())))
    assert widest >= 1
    return out


def test_uniforms():
    b0, b1 = base("x", 1)
    got = B.uniforms(b0, b1, 7, 5, 1000)
    assert got.tolist() == [u_plain(b0, b1, 7, j) for j in range(5, 1005)]
    assert 0 <= got.min() and got.max() < 1 and abs(got.mean() - 0.5) < 0.03
    sql = BS.uniform_sql(f"SELECT {b0}::BIGINT AS b0, {b1}::BIGINT AS b1, 7 AS rep, j FROM range(5, 1005) t(j)", "rep", "j")
    assert [r[0] for r in duckdb.sql(f"SELECT u FROM ({sql}) ORDER BY j").fetchall()] == got.tolist()


def test_draw_counts(monkeypatch):
    sizes = np.array([3, 0, 5, 1, 90])
    b = base("k")
    want = np.zeros(5, int)
    owner = np.repeat(np.arange(5), sizes)
    for j in range(4, 304):
        want[owner[int(u_plain(*b, 2, j) * 99)]] += 1
    assert B.draw_counts(sizes, 300, *b, 2, 4).tolist() == want.tolist()
    monkeypatch.setattr(B, "BLOCK", 7)  # draws in many blocks, parts found by their ends
    assert B.draw_counts(sizes, 300, *b, 2, 4).tolist() == want.tolist()
    assert B.draw_counts(np.array([0, 4]), 9, *b, 1).tolist() == [0, 9]
    assert B.draw_counts(sizes, 0, *b, 1).tolist() == B.draw_counts(np.zeros(5, int), 3, *b, 1).tolist() == [0] * 5


def test_slots_of_several_rows(monkeypatch):
    """Slots that hold the end of a part are looked up draw by draw."""
    monkeypatch.setattr(B, "ROWS", 50)
    monkeypatch.setattr(B, "GRID", 4)
    monkeypatch.setattr(B, "BLOCK", 64)
    for sizes in ([3, 0, 5, 1, 90], [1] * 99, [400, 2, 0, 1, 397], [0, 1000, 1, 0]):
        sizes, b = np.array(sizes), base("s", len(sizes))
        want = np.zeros(len(sizes), int)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for j in range(9, 709):
            want[owner[int(u_plain(*b, 3, j) * len(owner))]] += 1
        parts = B.Parts(sizes)
        assert parts.shift > 0 and [parts.counts(700, *b, 3, 9).tolist() for _ in range(2)] == [want.tolist()] * 2


def test_cells_do_not_travel_with_each_replicate(spark, monkeypatch):
    """A span's cells go once for a unit of draws: rows that reach the draws do not grow with cells times replicates."""
    seen = []
    split = B._cell_counts

    def spy(cells, *args):
        seen.append((cells.count(), args[-1]))
        return split(cells, *args)

    monkeypatch.setattr(B, "_cell_counts", spy)
    df = spark.range(4000).selectExpr("'s' as study", "'m' as model", "cast(id % 2 as int) as label", "cast(id as double) as score")
    b = B.auc_bootstrap(df, reps=50, cell=20, fan=1 << 10)
    assert b.first().n_reps == 50 and seen[0][0] == 400 and seen[0][1] >= 2000 * 50  # all replicates of a class are one unit
    assert "todo" in b._jdf.queryExecution().analyzed().toString()


def test_counts_are_multinomial():
    sizes = np.array([10, 20, 30, 40])
    x = np.array([B.draw_counts(sizes, 100, *base("m"), r) for r in range(4000)])
    p = sizes / 100
    assert np.allclose(x.mean(0), 100 * p, atol=0.4)
    cov = 100 * (np.diag(p) - np.outer(p, p))
    assert np.allclose(np.cov(x.T), cov, atol=1.6)


@pytest.mark.parametrize("cell,fan", [(1000, 4), (10, 100), (10, 2), (1, 3)])
def test_any_cells_and_spans(spark, cell, fan):
    rng = np.random.default_rng(cell)
    groups = {("a", "m"): [(float(np.round(rng.normal(y, 1), 1)), y) for y in rng.integers(0, 2, 60).tolist()], ("b", "m"): [(float(i % 3), i % 2) for i in range(40)]}
    rows = [(*k, int(y), s) for k, v in groups.items() for s, y in v] + [("a", "m", None, 1.0), ("a", "m", 1, None), ("a", "m", 5, 2.0)]
    got = B.auc_bootstrap(spark.createDataFrame(rows, "study string, model string, label int, score double"), reps=12, seed=3, cell=cell, fan=fan).collect()
    assert len(got) == 2
    for r in got:
        want = brute(groups[r.study, r.model], (r.study, r.model), 12, 3, cell, fan)
        assert r.n_reps == 12
        assert (r.auc_lo, r.auc_med, r.auc_hi) == pytest.approx(tuple(np.quantile(want, [0.025, 0.5, 0.975])), abs=1e-12)


def test_a_group_with_one_class_and_an_empty_table(spark):
    schema = "study string, model string, label int, score double"
    rows = [("a", "m", 1, float(i)) for i in range(5)] + [(None, "m", i % 2, float(i)) for i in range(8)]
    got = {r.study: r for r in B.auc_bootstrap(spark.createDataFrame(rows, schema), reps=5).collect()}
    assert (got["a"].n_reps, got["a"].auc_lo) == (0, None) and got[None].n_reps == 5 and got[None].auc_lo is not None
    assert B.auc_bootstrap(spark.createDataFrame([], schema), reps=5).count() == 0


def test_no_row_per_draw(spark):
    df = spark.range(3000).selectExpr("'s' as study", "'m' as model", "cast(id % 2 as int) as label", "cast(id as double) as score")
    plan = B.auc_bootstrap(df, reps=200, cell=1000)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "MapInArrow" in plan
