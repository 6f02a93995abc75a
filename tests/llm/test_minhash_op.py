import random

import numpy as np
import pyarrow as pa
import pytest
from corpus_helpers import Groups, prose, shingle_set

from sigspark.llm import minhash_forest as forest
from sigspark.llm.queries import op8_minhash_forest
from sigspark.llm.text import buffers


def brute(docs, k=3, least=85):
    """{id: (set size, component)} over all pairs of different sets."""
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    g, first = Groups({i for i, _ in docs}), {}
    for i, s in sets:
        if s and i is not None:
            if s in first:
                g.join(first[s], i) if first[s] != i else None
            else:
                first[s] = i
    by = {}
    for s in first:
        for x in s:
            by.setdefault(x, []).append(s)
    for s in first:
        common = {}
        for x in s:
            for t in by[x]:
                common[t] = common.get(t, 0) + 1
        for t, n in common.items():
            if t is not s and 100 * n >= least * (len(s) + len(t) - n) and g.find(first[s]) != g.find(first[t]):
                g.join(first[s], first[t])
    return {i: (len(s), g.find(i)) for i, s in sets}


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus(rng):
    docs = []
    for group in range(40):
        base = prose(rng, rng.choice([3, 10, 60, 200]))
        docs.append(base)
        for _ in range(rng.choice([0, 1, 4, 12])):
            docs.append(edited(rng, base, rng.randrange(0, max(2, len(base) // 30))))
    docs += [prose(rng, rng.choice([1, 2, 3, 50])) for _ in range(100)]
    rng.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def run(spark, docs):
    return forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()


def test_against_brute_force(spark, rng):
    docs = corpus(rng)
    want = brute(docs)
    rows = run(spark, docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_dense_cloud_around_the_threshold(spark):
    """One large group of copies with a few edits each, whose similarities lie on both sides of the threshold."""
    rng = random.Random(9)
    base = prose(rng, 150, 10**6)
    docs = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4])))) for i in range(400)]
    want = brute(docs)
    got = {r.doc_id: r.component_id for r in run(spark, docs)}
    assert len({c for _, c in want.values()}) > 5
    assert sum(got[i] == want[i][1] for i in got) == len(got)


def test_many_exact_copies_are_one_class(spark):
    docs = [(i, "a b c d e f g") for i in range(500)] + [(1000, "A b C d e f g"), (1001, "x y z")]
    got = {r.doc_id: r for r in run(spark, docs)}
    assert all(got[i].component_id == 0 for i in [*range(500), 1000]) and got[1001].kept


@pytest.mark.parametrize("parts", [1, 5])
def test_candidates_across_partition_borders(spark, rng, parts):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = [(i, f"same words here for all of them {i % 5}") for i in range(60)]
        assert {r.component_id for r in run(spark, docs)} == {c for _, c in brute(docs).values()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    base = prose(rng, 400, 10**6)
    texts = [" ".join(base)] + [" ".join(edited(rng, base, n)) for n in (2, 5, 15, 60)]
    data, offs = buffers(pa.array(texts))
    sig = forest.signatures(*forest.shingle_sets(data, offs, 0, 5, 3))
    sets = [shingle_set(t, 3) for t in texts]
    for k in range(1, 5):
        true = len(sets[0] & sets[k]) / len(sets[0] | sets[k])
        assert abs((sig[0] == sig[k]).mean() - true) < 0.14


def test_depth_adapts_to_the_region():
    label = np.zeros((40, 1 + 2 * forest.DEPTH), np.uint8)  # a dense region: next neighbours, and it is noted
    a, b, _, dense = forest.neighbours(label, np.arange(40))
    assert set((b - a).tolist()) == {1, 2} and dense.all()
    few = label[:5].copy()
    few[4, 2 * forest.LEAST + 1 :] = 1
    a, b, shared, _ = forest.neighbours(few, np.arange(5))
    assert len(a) == 10 and sorted(shared.tolist()) == [forest.LEAST] * 4 + [forest.DEPTH] * 6  # all pairs of a small region


@pytest.mark.parametrize("large", [30, 4096])
def test_dense_regions_in_chunks_and_parts(spark, monkeypatch, large):
    rng = random.Random(3)
    base = prose(rng, 100, 10**6)
    docs = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3])))) for i in range(150)]
    monkeypatch.setattr(forest, "LARGE", large)
    monkeypatch.setattr(forest, "CHUNK", 16)
    want = brute(docs)
    got = {r.doc_id: r.component_id for r in run(spark, docs)}
    assert sum(got[i] == want[i][1] for i in got) >= 0.99 * len(got)


def test_a_cloud_beyond_the_largest_region(spark):
    """Near copies of one template, each linked with the template itself: one component, whatever the region's size."""
    rng = random.Random(8)
    base = prose(rng, 120, 10**6)
    docs = [(0, " ".join(base))] + [(i, " ".join(w if k not in at else f"new{i}x{k}" for k, w in enumerate(base))) for i in range(1, 6000) for at in [set(rng.sample(range(120), rng.choice([1, 2, 3])))]]
    assert len(docs) > forest.LARGE
    sets = [shingle_set(t, 3) for _, t in docs]
    assert all(100 * len(sets[0] & s) >= 85 * len(sets[0] | s) for s in sets)
    assert {r.component_id for r in run(spark, docs)} == {0}


def test_intersections():
    sets = [[], [1, 2, 3], [2, 3, 9], [1, 2, 3, 4, 5], [77]]
    common, size = forest.intersections(pa.array(sets, pa.list_(pa.int64())))
    assert size.tolist() == [0, 3, 3, 5, 1]
    assert all(common[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(5) for j in range(5) if i != j)


def test_odd_rows(spark, odd_documents):
    rows = forest.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    got = {r.doc_id: r for r in rows}
    assert all(got[i].n_shingles == 0 and got[i].component_id == i and got[i].kept for i in (1, 2, 3))
    assert got[5].component_id == 4 and got[None].component_id == 4 and not got[None].kept and got[4].kept
    assert got[6].n_shingles == 5000 and got[7].n_shingles == got[8].n_shingles == 1
    assert forest.near_duplicates(odd_documents.limit(0)).count() == 0
    assert [r.kept for r in forest.near_duplicates(odd_documents.where("doc_id is null")).collect()] == [True]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op8_minhash_forest(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs)
