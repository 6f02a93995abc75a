import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspark.llm import codes
from sigspark.llm.queries import ORACLES, op11_vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds):
    """{(id, vector): (code, error)} and the codebooks' digest, in Python's whole numbers."""
    kept = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return {}, None
    w = len(kept[0][1]) // parts
    x = [[[math.floor(256 * v) for v in r[1][p * w : p * w + w]] for p in range(parts)] for r in kept]
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]

    def assign(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for v in x:
                met.setdefault(assign(p, v[p])[1], []).append(v[p])
            for e, vs in met.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = {}
    for r, v in zip(kept, x, strict=True):
        best = [assign(p, v[p]) for p in range(parts)]
        out[(r[0], tuple(r[1]))] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best))
    text = ",".join(str(n) for book in books for c in book for n in c)
    return out, hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, parts, entries, rounds=2):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    book = codes.train(df, parts=parts, entries=entries, rounds=rounds)
    if book is None:
        return {}, None
    got = codes.encode(df, book, keep=("vec_id", "embedding")).collect()
    return {(r.vec_id, tuple(r.embedding)): (r.code, r.error) for r in got}, book.sha256()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 62), st.integers(1, 70))
def test_products_are_exact(seed, size, depth):
    rng = np.random.default_rng(seed)
    bound = 1 << (size // 2)
    a, b = rng.integers(-bound, bound, (3, 5, depth)), rng.integers(-bound, bound, (3, depth, 4))
    a[0, 0], b[0, :, 0] = -bound, bound - 1
    want = a.astype(object) @ b.astype(object)
    if abs(want).max() < 2**63:
        assert (codes.exact_products(a, b).astype(object) == want).all()


def test_one_product_in_doubles_would_not_do():
    a = np.full((1, 1, 4), (1 << 29) + 1)
    assert int(a[0, 0].astype(float) @ a[0, 0].astype(float)) != 4 * ((1 << 29) + 1) ** 2
    assert codes.exact_products(a, a.transpose(0, 2, 1))[0, 0, 0] == 4 * ((1 << 29) + 1) ** 2


def test_limbs():
    x = np.array([0, 1, -1, 2**40 + 3, -(2**40) - 3, 2**62, -(2**62)])
    for bits in (5, 24, 31):
        assert sum(v.astype(int).astype(object) << (i * bits) for i, v in enumerate(codes.limbs(x, bits))).tolist() == x.tolist()


@pytest.mark.parametrize("scale", [0.3, 90_000.0])
def test_against_whole_numbers(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(0, scale, 12).clip(-130_000, 130_000)], int(i) % 3) for i in rng.permutation(200)]
    assert run(spark, rows, 4, 8) == brute(rows, 4, 8, 2)


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    rows = [(i, [0.0, 1.0] if i % 2 else [0.0, -1.0], 0) for i in range(10)]
    got, sha = run(spark, rows, 1, 6)
    assert (got, sha) == brute(rows, 1, 6, 2)
    assert {c for c, _ in got.values()} == {"00", "01"}


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (None, [0.5, 0.25], 1), (3, None, 1), (4, [], 1), (5, [None, 1.0], None), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (12, [1.0, 2.0, 3.0], 2),
        (9, [0.1, -0.1], None), (9, [0.1, -0.1], None), (9, [0.2, -0.3], 1), (10, [-0.001, 0.0], 1), (11, [0.0, 0.0], 4),
    ]
    assert run(spark, rows, 2, 3) == brute(rows, 2, 3, 2)
    assert run(spark, rows[1:7], 1, 3)[1] == brute([rows[6]], 1, 3, 2)[1]
    assert run(spark, [], 1, 3) == run(spark, rows[1:6], 1, 3) == ({}, None)
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, rows, 5, 3)
    with pytest.raises(Exception, match="component is over"):
        run(spark, [(1, [1e9], 0)], 1, 3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code_", "2 as n", "3 as k", "4 as s0", "5 as __vector", "6 as i", "7 as v", "8 as __sum")
    book = codes.train(df, parts=2, entries=3)
    got = codes.encode(df, book, keep=tuple(df.columns))
    assert got.columns == [*df.columns, "code", "error"] and got.count() == 6
    with pytest.raises(ValueError, match="columns of the result"):
        codes.encode(df.withColumn("Code", df.n), book, keep=("Code",))


@pytest.mark.parametrize("hot", [1, 2, 4096])
def test_group_error(spark, monkeypatch, hot):
    monkeypatch.setattr(codes, "HOT_LABELS", hot)
    rows = [(i, lab, i * i) for i, lab in enumerate([None, None, "a", "a", "a", "b", None, "c", "a"])] + [(9, "d", 2**62), (10, "d", 2**62)]
    got = codes.with_group_error(spark.createDataFrame(rows, "vec_id long, label string, error long")).collect()
    sums = {}
    for _, lab, e in rows:
        sums[lab] = sums.get(lab, 0) + e
    sums["d"] = None
    assert sorted((r.vec_id, r.label_error) for r in got) == [(i, sums[lab]) for i, lab, _ in rows]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{sf}/embeddings.parquet'")
    got = op11_vector_codes(spark, sf)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(ORACLES["op11_vector_codes"]).fetchall())


def test_query_on_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_vector_codes(spark, str(tmp_path))
    assert got.count() == 0
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
