"""Clusters against plain k-means, and the bounds of exponion search."""

import hashlib
import math
import random

import numpy as np
import pytest
from barloom.llm import clusters
from pyspark.sql import functions as F


def plain(rows, k, rounds, seed=2, width=64):
    """(vec_id, cluster, distance) of each usable row in order, and the final centroids, one distance at a time in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) < clusters.LIMIT / 256 for x in v)]
    by_hash = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    points = [v for _, v in by_hash[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        own = [min((far(v, p), c) for c, p in enumerate(points)) for _, v in kept]
        if step < rounds:
            for c in range(len(points)):
                mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == c]
                if mine:
                    points[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, own, strict=True)], points


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "rows": F.lit(1)}).repartition(3)


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def lattice(seed, n=300, width=64, spread=3):
    """Vectors on few points of a lattice, so that many distances tie, with repeated rows and ids."""
    draw = random.Random(seed)
    rows = [(draw.randrange(n), [draw.randrange(spread) / 64 if j < 4 else 0.0 for j in range(width)]) for _ in range(n)]
    return rows + rows[:20]


EDGES = [(1, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64), (None, [0.5] * 64), (3, None), (4, []), (5, [1.0] * 63), (6, [float("nan"), *[0.0] * 63]), (7, [float("inf"), *[0.0] * 63]), (8, [None, *[0.0] * 63]), (9, [3e38, *[0.0] * 63]), (10, [-0.001] * 64), (11, [500_000.0] * 64)]


@pytest.mark.parametrize(("rows", "k", "rounds"), [(lattice(1), 12, 5), (lattice(2, spread=2), 40, 5), (lattice(3), 1, 2), (EDGES, 40, 5), (EDGES, 2, 3)], ids=["ties", "empty clusters", "one", "edges", "two"])
def test_clusters_equal_plain_rounds(spark, rows, k, rounds):
    found, points = clusters.cluster(frame(spark, rows), k=k, rounds=rounds)
    expected, centroids = plain(as_floats(rows), k, rounds)
    assert points == centroids
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_summary(spark):
    found, points = clusters.cluster(frame(spark, lattice(5)), k=7)
    rows = clusters.summary(found, points).collect()
    assert len(rows) == 320 and {r.inertia for r in rows} == {sum(r.distance for r in rows)}
    for r in rows:
        assert r.cluster_inertia == sum(x.distance for x in rows if x.cluster == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, points[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(None, [0.5] * 64)], [(1, None)]], ids=["none", "no ids", "no vectors"])
def test_nothing_to_cluster(spark, rows):
    found, points = clusters.cluster(frame(spark, rows))
    assert found.count() == 0 and points == [] and clusters.summary(found, points).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 19])
def test_balls_hold_the_nearest_and_few_others(scale):
    draw = np.random.default_rng(4)
    middles = draw.integers(-200, 200, (30, 64)) * scale
    rows = (middles[draw.integers(0, 30, 3000)] + draw.integers(-9, 9, (3000, 64)) * scale).astype(np.int64)
    points = rows[:40].copy()
    state, spent = clusters.first_places(rows, clusters.Centroids.of(points)), 0
    for _ in range(4):
        last, points = points, np.array([rows[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else points[c] for c in range(40)])
        shift = np.sqrt(((points - last) ** 2).sum(axis=1).astype(float))
        *state, n = clusters.placed_again(rows, state[0], *clusters.moved(*state, shift), clusters.Centroids.of(points))
        spent += n
        far = np.stack([((rows - p) ** 2).sum(axis=1) for p in points], axis=1)
        assert (state[0] == far.argmin(axis=1)).all()
        real = np.sqrt(np.sort(far, axis=1).astype(float))
        assert (state[1] * (1 + 1e-8) >= real[:, 0]).all() and (state[2] * (1 - 1e-8) <= real[:, 1]).all()
    assert spent < 4 * 3000 * 40 / 4
