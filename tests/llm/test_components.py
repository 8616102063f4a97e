"""Connected components against union-find, on chains, stars and random graphs."""

import random

import pytest

from basketflow.llm.components import components
from basketflow.session import Scratch


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


CASES = {
    "chain": [(i, i + 1) for i in range(60)],
    "star": [(500, i) for i in range(200)],
    "random": [(random.Random(i).randrange(150), random.Random(-i).randrange(150)) for i in range(90)],
    "odd": [(None, 1), (2, None), (3, 3), (7, 5), (5, 7), (7, 5), (-4, 7)],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_equal_to_union_find(spark, name):
    edges = CASES[name]
    with Scratch(spark) as scratch:
        found = components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    assert {r.node: r.component for r in found} == brute(edges)
    assert len(found) == len(brute(edges))
