import random

from massif.operators import graph


def test_paths_stars_and_random_graphs(spark):
    r = random.Random(1)
    ids = r.sample(range(10**6), 900)
    edges = [(ids[i], ids[i + 1]) for i in range(399)] + [(ids[400], x) for x in ids[401:600]] + [(r.choice(ids[600:]), r.choice(ids[600:])) for _ in range(200)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.label for x in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_are_few_on_paths_in_order_of_their_ids(spark):
    n = 5000
    found = graph.connected(spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b"))
    assert found._rounds <= 9
    assert found.count() == n and {x.label for x in found.select("label").distinct().collect()} == {0}
