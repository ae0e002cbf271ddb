"""Components against a plain union-find, by one task and by rounds of stars."""

import random

import pytest

from fieldmesh.operators import graph


def roots(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("held", [500_000, 40])
@pytest.mark.parametrize("kind", ["random", "path", "names"])
def test_components(spark, monkeypatch, held, kind):
    monkeypatch.setattr(graph, "LOCAL_NODES", held)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(120)] if kind == "path" else [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    edges += [(5, 5), (907, 907)]
    if kind == "names":
        edges = [(f"n{a}é", f"n{b}é") for a, b in edges]
    t = "string" if kind == "names" else "long"
    df = spark.createDataFrame([*edges, (edges[0][0], None)], f"a {t}, b {t}").repartition(4)
    assert dict(graph.components(df).collect()) == roots(edges)
    lone = spark.createDataFrame([(edges[0][0],), ("x" if kind == "names" else -7,)], f"node {t}")
    assert len(graph.components(df, lone).collect()) == len(roots(edges)) + 1
