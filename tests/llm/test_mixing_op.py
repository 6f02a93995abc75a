import random
from fractions import Fraction

from corpus_helpers import words

from sigspark.llm import mixing
from sigspark.llm.queries import op2_mixing

CODE_POINTS = lambda s: (s is None, s or "")


def brute_targets(size, share=1.5, cap=2, weights=(5, 2, 1)):
    """Share by weight, cut at the cap, share the excess again, until nothing is above."""
    names = sorted(size, key=CODE_POINTS)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(share) * sum(size.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > cap * size[s]}
        if not above:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in above:
            out[s] = Fraction(cap * size[s])
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def brute_sainte_lague(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats if any(votes.values()) else 0):
        best = max(votes, key=lambda p: (Fraction(votes[p]) / (2 * got[p] + 1), -p))
        got[best] += 1
    return got


def check(rows, docs):
    size = {}
    for _, text, source in docs:
        size[source] = size.get(source, 0) + len(words(text))
    want, taken = brute_targets(size), dict.fromkeys(size, 0)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert abs(r.target - float(want[r.source])) <= 1e-9 * max(1, r.target)
        taken[r.source] += r.taken
    shards = {s: -(-n // 200) + 1 for s, n in size.items()}
    for s in size:
        assert abs(taken[s] - want[s]) <= 16 * (shards[s] + 1), (s, taken[s], want[s])


def test_targets_and_taken_words(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 30, 200])), rng.choice(["a"] * 12 + ["b", "c", "Z", "é", None, "d", "e"])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    one = mixing.mix_sources(df, shard=200).collect()
    assert sorted(r.doc_id for r in one) == list(range(400))
    check(one, docs)
    again = mixing.mix_sources(df.repartition(7), shard=200).collect()
    assert {r.doc_id: r.taken for r in one} == {r.doc_id: r.taken for r in again}


def test_two_levels_of_dealing(spark):
    """Spans of any number of shards: the targets are met as closely, and reruns agree; one span deals as before."""
    rng = random.Random(6)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 30, 200])), rng.choice("aaaaaabc")) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    whole = {r.doc_id: r.taken for r in mixing.mix_sources(df, shard=200, span=1 << 20).collect()}
    assert {r.doc_id: r.taken for r in mixing.mix_sources(df, shard=200).collect()} == whole
    for span in (1, 3, 10):
        rows = mixing.mix_sources(df, shard=200, span=span).collect()
        check(rows, docs)
        assert {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(5), shard=200, span=span).collect()} == {r.doc_id: r.taken for r in rows}


def test_sainte_lague_matches_dealing_one_by_one(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(12):
        votes = {p: rng.choice([0, 1, 7, 7, 50, 1000, 33]) for p in range(rng.randrange(1, 9))}
        seats = rng.randrange(0, 60)
        rows += [(g, p, float(v), seats) for p, v in votes.items()]
        want |= {(g, p): n for p, n in brute_sainte_lague(votes, seats).items()}
    df = spark.createDataFrame(rows, "g long, p long, votes double, seats long")
    got = {(r.g, r.p): r.quota for r in mixing.sainte_lague(df, ["g"], ["p"], "votes", "seats").collect()}
    assert got == want


def test_odd_rows(spark, odd_documents):
    rows = mixing.mix_sources(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].size == by[2].size == by[3].size == 0 and by[6].size == 60_000
    check(rows, [(r.doc_id, r.text, r.source) for r in odd_documents.collect()])
    assert mixing.mix_sources(odd_documents.limit(0)).count() == 0
    blank = mixing.mix_sources(odd_documents.where("doc_id < 4")).collect()
    assert [r.taken for r in blank] == [0, 0, 0] and [r.target for r in blank] == [0.0] * 3


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    source = {i: s for i, _, s in docs}
    got = op2_mixing(spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(words(t)) for i, t, _ in docs}
    total = sum(r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 16 * 40
    assert len(source) == len(rows)


def test_plan_has_no_python(spark):
    plan = op2_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
