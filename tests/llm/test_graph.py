"""Connected components against a plain union-find."""

import random

import pytest

from corpusloom.llm.graph import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def shuffled_path(n):
    names = random.Random(4).sample(range(-500, 500), n)
    return list(zip(names, names[1:]))


GRAPHS = {
    "nothing": [],
    "loops and repeats": [(3, 3), (1, 2), (2, 1), (1, 2)],
    "path": shuffled_path(120),
    "hub": [(70, k) for k in range(60)] + [(k, k + 100) for k in range(0, 60, 7)],
    "sparse": [tuple(random.Random(k).choices(range(300), k=2)) for k in range(170)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = spark.createDataFrame(GRAPHS[name], "u long, v long")
    found = components(edges).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == plain(GRAPHS[name])
