import numpy as np
from corpus_helpers import Groups

from sigspark.llm import capfilter
from sigspark.llm.queries import op3_cap_filters


def brute(vectors, least=0.9):
    """{id: (links, component)} over all pairs, one row an entry."""
    keep = {}
    for k, (_, v) in enumerate(vectors):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            keep[k] = x / np.linalg.norm(x)
    g, links = Groups({i for i, _ in vectors}), dict.fromkeys(range(len(vectors)), 0)
    for k, x in keep.items():
        for m, y in keep.items():
            if k < m and len(x) == len(y) and x @ y >= least:
                links[k] += 1
                links[m] += 1
                if vectors[k][0] != vectors[m][0]:
                    g.join(vectors[k][0], vectors[m][0])
    return links, g


def clustered(rng, n, dim, spread):
    centres = rng.normal(size=(n // 8 + 1, dim))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dim))
    return x.astype(np.float32)


def compare(spark, vectors, recall, schema="vec_id long, embedding array<float>"):
    rows = capfilter.near_vectors(spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], schema)).collect()
    links, g = brute(vectors)
    want = {i: links[k] for k, (i, _) in enumerate(vectors)}
    got = {r.vec_id: r for r in rows}
    assert len(rows) == len(vectors)
    assert all(got[i].n_links <= want[i] for i in want)
    assert sum(r.n_links for r in got.values()) >= recall * sum(want.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return got, want, g


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    for dim, spread in ((64, 0.25), (16, 0.2)):
        x = clustered(rng, 1500, dim, spread)
        got, want, g = compare(spark, list(enumerate(x)), 0.99)
        assert sum(want.values()) > 1000
        assert sum(got[i].component_id == g.find(i) for i in want) >= 0.98 * len(want)


def test_one_large_group_of_near_copies_and_of_copies(spark):
    rng = np.random.default_rng(2)
    near = np.ones(32) + 0.05 * rng.normal(size=(1300, 32))  # over CHUNK
    x = [*near, *[near[0]] * 50, *rng.normal(size=(200, 32))]
    x = np.array(x, np.float32)
    got, want, g = compare(spark, list(enumerate(x)), 1.0)
    assert {i: got[i].n_links for i in got} == want and {i: got[i].component_id for i in got} == {i: g.find(i) for i in got}


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    v = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [3.0]), (12, [5.0]), (13, [-5.0]), (14, [1e30, 1e-30])]
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame(v + [(None, [1.0, 0.0])], schema).selectExpr("*", "1 as id", "2 as v", "3 as fit", "4 as n_links", "5 as h1")
    rows = capfilter.near_vectors(df).collect()
    assert len(rows) == len(v) + 1
    got = {r.vec_id: r for r in rows}
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1, 2, 3, 4, 5, 6, 10, 13))
    assert got[7].n_links == 4 and got[8].component_id == 7 and got[14].component_id == 7 and got[12].component_id == 11 and got[None].n_links == 0
    assert capfilter.near_vectors(df.limit(0)).count() == 0
    doubles = df.selectExpr("vec_id", "cast(embedding as array<double>) embedding").where("vec_id in (7, 8)")
    assert [r.n_links for r in capfilter.near_vectors(doubles).collect()] == [1, 1]


def test_query_on_its_table(spark):
    sf = "/root/testdata/sf0.01"
    v = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links, g = brute(v)
    got = {r.vec_id: r for r in op3_cap_filters(spark, sf).collect()}
    assert {i: got[i].n_links for i, _ in v} == {i: links[k] for k, (i, _) in enumerate(v)}
    assert {i: got[i].component_id for i, _ in v} == {i: g.find(i) for i, _ in v}
