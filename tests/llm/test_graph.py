"""Connected components: chains, stars, cliques and self links, against union by search."""

import random

from driftline.llm import _graph


def smallest(links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    comp = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = start
                todo += near[x]
    return comp


def found(spark, links):
    return {r.node: r.comp for r in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}


def test_chain_of_a_thousand_links(spark):
    rng = random.Random(5)
    names = [rng.getrandbits(63) - (1 << 62) for _ in range(1001)]
    assert set(found(spark, list(zip(names, names[1:]))).values()) == {min(names)}


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 200)]  # names in order: one deep tree of pointers
    links += [(1000 + rng.randrange(150), 1000 + rng.randrange(150)) for _ in range(120)]
    links += [(5000, 5000 + i) for i in range(1, 60)] + [(7000 + i, 7059) for i in range(59)]
    links += [(8000 + i, 8000 + j) for i in range(6) for j in range(6)] + [(9000, 9000), (9001, 9002), (9002, 9001), (9001, 9002)]
    assert found(spark, links) == smallest(links)
    assert found(spark, [(1, 1)]) == {}
