"""Clustering around centroids by exponion search.

Vectors stand in blocks, each with the number of its centroid, an upper bound of the distance to it and a lower
bound of the distance to any other. After centroids have moved, the bounds are widened by how far they moved. Where
the bounds don't settle it, the nearest and the second nearest centroid are within a ball around the vector's centroid, of
radius twice the upper bound plus the distance to that centroid's own nearest one; the centroids inside are a prefix of
its list of the others by distance, so only these are compared. The radius is inclusive, so ties are seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import forget, settled, to_python

#: Integers of this magnitude or more take no part: squared distances of vectors of WIDEST of them might not fit a long.
LIMIT, WIDEST = 1 << 27, 64
#: Bounds are doubles, a few roundings away from what they stand for; no comparison that is closer than this settles anything.
_SLACK = 1e-9
_BLOCK = "ids binary, nulls binary, rows binary, own binary, upper binary, lower binary"


def whole(vector: Column, width: int) -> Column:
    """The vector's components times 256, rounded down, as longs; null unless it has `width` finite components of less than LIMIT / 256."""
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / 256)
    x = vector.cast("array<double>")
    return F.when((F.size(x) == width) & F.forall(x, inside), F.transform(x, lambda c: F.floor(c * 256).cast("long")))


class Centroids(NamedTuple):
    """Integer centroids, and for each its distances to all in ascending order, with their numbers."""

    points: np.ndarray
    gaps: np.ndarray
    lists: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Centroids:
        far = np.sqrt(squares(points, points).astype(np.float64))
        lists = np.argsort(far, axis=1, kind="stable")
        # the first of each list is the centroid itself, or its equal
        return cls(points, np.take_along_axis(far, lists, 1), lists)

    def nearest_other(self) -> np.ndarray:
        return self.gaps[:, 1] if len(self.points) > 1 else np.full(len(self.points), np.inf)


def squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of each of rows to each of points."""
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(points).max(initial=0)))
    if top < 1 << 22:  # every sum is an integer below 2**53, so doubles are exact
        a, b = rows.astype(np.float64), points.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(rows), len(points)), np.int64)
    for k, point in enumerate(points):
        gap = rows - point
        out[:, k] = (gap * gap).sum(axis=1)
    return out


def _two_nearest(square: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of squared distances to the centroids `names` (-1 in square: not compared): the nearest's number, the smaller one on a tie, its
    squared distance, and the distance of the next (inf without one)."""
    none = np.iinfo(np.int64).max
    square = np.where(square < 0, none, square)
    least = square.min(axis=1)
    best = np.where(square == least[:, None], names, none).min(axis=1)
    rest = np.where(names == best[:, None], none, square).min(axis=1)
    return best, least, np.where(rest == none, np.inf, np.sqrt(rest.astype(np.float64)))


def first_places(rows: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, upper and lower bound of each row, all centroids compared."""
    best, least, rest = _two_nearest(squares(rows, at.points), np.broadcast_to(np.arange(len(at.points)), (len(rows), len(at.points))))
    return best, np.sqrt(least.astype(np.float64)), rest


def moved(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after each centroid went as far as `shift` says."""
    order = np.argsort(-shift, kind="stable")
    most = np.full(len(own), shift[order[0]])
    most[own == order[0]] = shift[order[1]] if len(shift) > 1 else 0.0
    return (upper + shift[own]) * (1 + _SLACK), lower * (1 - _SLACK) - most


def placed_again(rows: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As first_places(), from bounds that hold; and how many distances were computed."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    other = at.nearest_other()
    sure = np.maximum(lower, other[own] / 2)
    open_ = np.flatnonzero(upper * (1 + _SLACK) >= sure * (1 - _SLACK))
    gap = rows[open_] - at.points[own[open_]]
    upper[open_] = np.sqrt((gap * gap).sum(axis=1).astype(np.float64))
    spent = len(open_)
    open_ = open_[upper[open_] * (1 + _SLACK) >= sure[open_] * (1 - _SLACK)]
    for c in np.unique(own[open_]):
        who = open_[own[open_] == c]
        reach = (2 * upper[who] + other[c]) * (1 + _SLACK)
        inside = np.searchsorted(at.gaps[c], reach, side="right")  # centroids in the ball, of c's list
        # rows whose balls hold about as many centroids go together
        level = np.ceil(np.log2(np.maximum(inside, 1))).astype(int)
        for k in np.unique(level):
            now, most = level == k, int(inside[level == k].max())
            names = at.lists[c, :most]
            square = squares(rows[who[now]], at.points[names])
            square[np.arange(most) >= inside[now][:, None]] = -1
            best, least, rest = _two_nearest(square, np.broadcast_to(names, square.shape))
            own[who[now]], upper[who[now]], lower[who[now]] = best, np.sqrt(least.astype(np.float64)), rest
            spent += int(inside[now].sum())
    return own, upper, lower, spent


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each batch of (vec_id, whole vector)."""
    for batch in batches:
        if len(batch):
            ids, nulls = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            rows = batch.column(1).flatten().to_numpy().reshape(len(batch), width)
            none = np.zeros(0)
            yield _block(ids, nulls, rows.astype(np.int32), none, none, none)


def _block(ids: np.ndarray, nulls: np.ndarray, rows: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    cells = (ids, nulls, rows, own.astype(np.int32), upper, lower)
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["ids", "nulls", "rows", "own", "upper", "lower"])


def _opened(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of each block: ids, nulls, rows as longs, own, upper, lower."""
    kinds = (np.int64, np.bool_, np.int32, np.int32, np.float64, np.float64)
    for k in range(len(batch)):
        cells = [np.frombuffer(c[k].as_buffer(), kind) for c, kind in zip(batch.columns, kinds, strict=True)]
        cells[2], cells[3] = cells[2].reshape(-1, width).astype(np.int64), cells[3].astype(np.int64)
        yield tuple(cells)


def _sums(blocks: DataFrame, clusters: int, width: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster, the number of its vectors and their componentwise sums. Tasks send a row for each cluster they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(clusters, np.int64), np.zeros((clusters, width), np.int64)
        for batch in batches:
            for _, _, rows, own, _, _ in _opened(batch, width):
                count += np.bincount(own, minlength=clusters)
                np.add.at(total, own, rows)
        have = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(count[have]), pa.array(list(total[have]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = to_python(blocks, run, "cluster long, n long, sums array<long>")
    cells = parts.select("cluster", F.posexplode(F.concat(F.array("n"), F.col("sums"))).alias("k", "x"))
    found = cells.groupBy("cluster", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out: dict[int, list[int]] = {}
    for r in found:
        out.setdefault(r.cluster, [0] * (width + 1))[r.k] = int(r.x)
    return {c: (cells[0], cells[1:]) for c, cells in out.items()}


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of each vector, the final centroids).

    vectors: vec_id, embedding. Components are taken as whole(); vectors of another length, null ones and those with
    a null, non-finite or too large component (LIMIT / 256 or more, whose squares a long can't hold) take no part. Centroids start as the k vectors with the smallest SHA-256 of
    'seed:vec_id', by hash, then (of repeated ids) by components; null ids give none; with fewer vectors there are fewer
    centroids. Each round assigns every vector to its nearest centroid by squared distance, the smaller number on a
    tie, and moves every centroid that has vectors to their componentwise mean, rounded down. Then vectors are assigned once more.

    Repeated rows each have their row; rows with null ids take part but give no first centroid. No rows, or none with an id: none. Other columns are ignored.
    The driver holds k centroids and their sums; no vector is shuffled. Each round rewrites the blocks with their bounds to the shared folder and
    forgets those of the round before.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), width).alias("row")).where("row is not null")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = [r.row for r in kept.where("vec_id is not null").select("row", by_hash.alias("hash")).orderBy("hash", "row").limit(k).collect()]
    spark = vectors.sparkSession
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    blocks = settled(to_python(kept, lambda batches: _blocks(batches, width), _BLOCK), "clusters-blocks")
    points, shift = np.array(start, np.int64), None
    for step in range(rounds + 1):
        before, blocks = blocks, settled(to_python(blocks, _pass(Centroids.of(points), shift, width), _BLOCK), "clusters-blocks")
        forget(before)
        if step == rounds:
            break
        last, points = points, points.copy()
        for c, (n, sums) in _sums(blocks, len(points), width).items():
            points[c] = [x // n for x in sums]
        shift = np.sqrt(((points - last) ** 2).sum(axis=1).astype(np.float64))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nulls, rows, own, _, _ in _opened(batch, width):
                gap = rows - points[own]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(own, pa.int32()), pa.array((gap * gap).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return to_python(blocks, rows_of, "vec_id long, cluster int, distance long"), points.tolist()


def _pass(at: Centroids, shift: np.ndarray | None, width: int):
    """Assigns each block anew, with all centroids compared in the first pass (shift None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nulls, rows, own, upper, lower in _opened(batch, width):
                if shift is None:
                    own, upper, lower = first_places(rows, at)
                else:
                    own, upper, lower, _ = placed_again(rows, own, *moved(own, upper, lower, shift), at)
                yield _block(ids, nulls, rows.astype(np.int32), own, upper, lower)

    return run


def summary(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found (vec_id, cluster, distance) with cluster_inertia, inertia and centroid_sha256, of one row for each cluster."""
    per = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    names = [(c, n, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in per.items()]
    told = found.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> str:
    """The rows of the query over embeddings in DuckDB SQL, every distance computed in every round."""
    floor = "(x - ((x % n) + n) % n) // n"
    parts = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LIMIT // 256})) = 0)",
        "cells AS (SELECT r, i, floor(x::DOUBLE * 256)::BIGINT AS x FROM (SELECT r, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM kept))",
        f"starts AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), embedding) - 1 AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})",
        "c0 AS (SELECT c, i, x FROM starts JOIN cells USING (r))",
    ]
    for step in range(rounds + 1):
        parts.append(f"d{step} AS (SELECT r, c, sum((a.x - b.x) * (a.x - b.x))::BIGINT AS d FROM cells a JOIN c{step} b USING (i) GROUP BY r, c)")
        parts.append(f"a{step} AS (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS k FROM d{step}) WHERE k = 1)")
        if step < rounds:
            parts.append(f"m{step} AS (SELECT c, i, {floor} AS x FROM (SELECT c, i, sum(x)::BIGINT AS x, count(*) AS n FROM cells JOIN a{step} USING (r) GROUP BY c, i))")
            parts.append(f"c{step + 1} AS (SELECT c, i, coalesce(m.x, b.x)::BIGINT AS x FROM c{step} b LEFT JOIN m{step} m USING (c, i))")
    return (
        "WITH " + ", ".join(parts) + f", names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) "
        f"SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN names USING (c)"
    )


SQL = sql()
