import random

from cairn.llm.components import connected


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_random_graphs_chains_and_hubs(spark):
    rng = random.Random(2)
    graphs = [
        [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1, 1), (None, 3), (5, 5)],
        [(i, i + 1) for i in range(64)] + [(i + 1, i) for i in range(64)],
        [(999, i) for i in range(300)] + [(i, 999) for i in range(300)],
        [],
    ]
    for edges in graphs:
        got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == roots(edges)


def test_strings(spark):
    got = connected(spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string")).collect()
    assert {r.node: r.component for r in got} == {"a": "a", "b": "a", "c": "a"}
