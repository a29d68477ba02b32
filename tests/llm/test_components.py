import random

from wordpair.llm.components import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)]
    edges += [(500, 500), (7, 6), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            up[root(a)] = root(b)
    nodes = {x for e in edges for x in e if None not in e and e[0] != e[1]}
    assert {r.node for r in got} == nodes
    mine = {r.node: r.root for r in got}
    assert len({(mine[x], root(x)) for x in nodes}) == len(set(mine.values())) == len({root(x) for x in nodes})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
