"""Components by joins against a plain search of the graph."""

import random

import pytest

from folioflow.llm.components import connected


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {(x, find(x)) for x in root if find(x) != x}


def graphs():
    r = random.Random(5)
    names = [r.randrange(-(2**62), 2**62) for _ in range(60)]
    yield "path in order", [(k, k + 1) for k in range(40)]
    yield "path of mixed names", list(zip(names, names[1:], strict=False))
    yield "star around its largest node", [(99, k) for k in range(30)]
    yield "star around its smallest node", [(k, -1) for k in range(30)]
    yield "ring", [(k, (k + 1) % 25) for k in range(25)]
    yield "random", [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    yield "loops and repeated edges", [(3, 3), (5, 4), (4, 5), (5, 4), (9, 9)]
    yield "only loops", [(1, 1)]


@pytest.mark.parametrize("edges", [pytest.param(e, id=name) for name, e in graphs()])
def test_connected(spark, edges):
    found = [(r["node"], r["root"]) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(edges)


def test_connected_of_nothing(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
