import random

from corpus_helpers import Groups

from sigspark.llm.components import components


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    links += [(1000 + i, 1001 + i) for i in range(60)]  # a long chain
    links += [(2000, 2000 + i) for i in range(1, 200)]  # a hub
    links += [(7, 7), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    g = Groups(nodes)
    for a, b in links:
        if a != b:
            g.join(a, b)
    assert got == {n: g.find(n) for n in nodes}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
