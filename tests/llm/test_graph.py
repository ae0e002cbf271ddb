"""Components against union-find, with a star, a self-loop and no edges."""

import random

from fieldmesh.llm.graph import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (2000, 2000)]
    root: dict[int, int] = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert dict(components(spark.createDataFrame(edges, "u long, v long")).collect()) == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
