"""Components of small graphs against union-find."""

import random
from pathlib import Path

import pytest

from barloom.llm.common import settled, shared_folder
from barloom.llm.components import components, towards_least


def _plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in list(parent))


def _mixed():
    draw = random.Random(3)
    path = list(range(60))
    draw.shuffle(path)
    return list(zip(path, path[1:])) + [(100 + draw.randrange(-90, 90), draw.randrange(200, 300)) for _ in range(80)] + [(500, i) for i in range(501, 560)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 2), (2, 5), (5, 2)], _mixed()], ids=["none", "itself", "repeated", "mixed"])
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == _plain(edges)


def test_stars_are_not_written_again(spark):
    links = settled(spark.createDataFrame([(1, 2), (1, 3), (4, 9)], "a long, b long"), "links")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert sorted(map(tuple, towards_least(links).collect())) == [(2, 1), (3, 1), (9, 4)]
    assert set(folder.iterdir()) == before and links.count() == 3
    path = settled(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"), "links")
    assert sorted(map(tuple, towards_least(path).collect())) == [(k, 0) for k in range(1, 21)] and path.count() == 20
