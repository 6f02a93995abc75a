import numpy as np
from pyspark.sql import functions as F

from sigspark.llm import toxicity
from sigspark.llm.queries import TOXIC, op7_toxicity


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_pairs_that_single_weights_miss(spark):
    """Toxic is an insult with a group's name; an insult for a thing and a group without an insult are not."""
    rng = np.random.default_rng(1)
    fill = [f"filler{k}" for k in range(300)]
    rows = []
    for i in range(2400):
        bad, group = rng.integers(0, 2, 2)
        w = list(rng.choice(fill, 20)) + (["dreadful"] if bad else ["splendid"]) + (["martians"] if group else ["weather"])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(bad and group)))
    train, test = rows[:1800], rows[1800:]
    docs, labels = tables(spark, train)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(tables(spark, test)[0], model).collect()}
    y = np.array([r[2] for r in test])
    s = np.array([got[r[0]] for r in test])
    assert auc(s, y) > 0.98
    a, b = (model.place[toxicity.terms(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 0, 1)[1]] for t in (b"dreadful", b"martians"))
    assert (a >= 0).any() and (b >= 0).any()
    assert model.factor[a[a >= 0]].sum(0) @ model.factor[b[b >= 0]].sum(0) > 0.1  # what the pair adds, over the slots of both words


def test_scores_follow_the_formula():
    rng = np.random.default_rng(2)
    m = toxicity.Model(0.3, np.zeros(1, np.int32), rng.normal(size=6), rng.normal(size=(6, 3)))
    sets = [[], [2], [0, 1, 5], [0, 1, 2, 3, 4, 5]]
    row = np.array([r for r, s in enumerate(sets) for _ in s], int)
    got = m.score(4, row, np.array([x for s in sets for x in s], int))
    for r, s in enumerate(sets):
        z = 0.3 + sum(m.weight[x] for x in s) + sum(m.factor[x] @ m.factor[y] for x in s for y in s if x < y)
        assert abs(got[r] - 1 / (1 + np.exp(-z))) < 1e-12


def slots(text):
    raw = text.encode()
    return set(toxicity.terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0, 1)[1].tolist())


def test_terms():
    assert len(slots("abc")) == 1 and slots("Abc") == slots("abc") == slots(" abc!")
    assert len(slots("abcdef")) == 3  # the word and its beginnings of four and five bytes
    assert len(slots("abcdefghijk")) == 6
    assert slots("abcdef") & slots("abcdzz") and not slots("abcd") & slots("abcdzz")  # a word is no beginning of itself
    once, twice = slots("abcdef abxyz"), slots("abcdef abcdzz")
    assert len(once) == 3 + 2 and len(twice) == 3 + 2 + 1  # the shared beginning, and that it is there twice
    assert len(slots("abc abc")) == 2 and not slots("") and not slots(" 12 !")


def test_an_id_in_many_rows_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 5)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 5)
    docs = spark.range(400).selectExpr("id % 2 as doc_id", "concat('some text ', translate(id, '0123456789', 'abcdefghij')) as text")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sets, *rest: seen.append(len(sets)))
    toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert seen == [20]


def test_calibrated_to_the_labels(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 5)), int(rng.random() < 0.1)) for i in range(4000)]
    docs, labels = tables(spark, rows)
    mean = toxicity.score(docs, toxicity.train(docs, labels)).agg(F.avg("score")).first()[0]
    assert abs(mean - np.mean([r[2] for r in rows])) < 0.04


def test_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (99, 1), (8, None), (None, 1), (9, 3)], "doc_id long, toxic int").selectExpr("*", "1 as i", "2 as y")
    rows = toxicity.score(odd_documents, toxicity.train(odd_documents, labels), keep=tuple(odd_documents.columns), out_col="p").collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.p <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].p == by[2].p == by[3].p
    assert toxicity.train(odd_documents, labels.limit(0)) == 0 and toxicity.train(odd_documents, labels.where("toxic = 1")) == 1
    assert toxicity.train(odd_documents.limit(0), labels) == 0.6  # labels without texts: their share of ones
    assert {r.score for r in toxicity.score(odd_documents, 0.25).collect()} == {0.25}
    assert toxicity.score(odd_documents.limit(0), toxicity.train(odd_documents, labels)).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has 14 toxic rows held out
    got = op7_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(both.score.to_numpy(), both.toxic.to_numpy()) > 0.97
    assert ((both.score >= TOXIC) == (both.predicted == 1)).all()
    toxic, clean = both[both.toxic == 1], both[both.toxic == 0]
    assert toxic.predicted.mean() >= 0.9 and clean.predicted.mean() <= 0.005
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    assert got.where(crc != F.col("held_out")).count() == 0


def test_the_fit_holds_no_vector_for_each_pair():
    """Memory of the fit: a few numbers for each (text, slot) pair, not one for each pair and factor."""
    import tracemalloc

    import numpy as np

    from sigspark.llm import toxicity

    rng = np.random.default_rng(3)
    y = np.arange(900) % 3 == 0
    sets = [np.unique(np.where(rng.random(2000) < 0.5, rng.integers(0, 4000, 2000) * 2 + one, rng.integers(0, 8000, 2000))).astype("<u4") for one in y]
    tracemalloc.start()
    m = toxicity.fit(sets, y.astype(float), 0.3, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = sum((m.place[x] >= 0).sum() for x in sets)
    assert pairs > 500_000 and peak < 90 * pairs
