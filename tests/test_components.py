"""Connected components against a plain union-find."""

import random

import pytest

from sparkcover.operators.components import connected_components

EDGE = "src bigint, dst bigint"


def plain(edges):
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def cases():
    rng = random.Random(5)
    many = [(50 * p + rng.randrange(12), 50 * p + rng.randrange(12)) for p in range(30) for _ in range(rng.randint(1, 12))]
    yield many + [(-7, -7), (-9, -8), (-8, -9), (-9, -8)]
    path = list(range(2000, 2200))
    rng.shuffle(path)
    hub = [(5000, 5000 + i) for i in range(1, 300)] + [(6000 + i, 5100 + i) for i in range(50)]
    yield list(zip(path, path[1:])) + hub


@pytest.mark.parametrize("edges", list(cases()), ids=["random", "path and hub"])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, EDGE)).collect()
    assert {r.id: r.component for r in got} == plain(edges) and len(got) == len(plain(edges))


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], EDGE)).count() == 0
