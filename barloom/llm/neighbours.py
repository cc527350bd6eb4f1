"""Nearest neighbours by cosine: vantage-point trees over shards.

Vectors are dealt to cells by the nearest of some pivots, and large cells are split into shards of bounded size, each with
a tree. A query is searched in its own cell first; with the distance found there, it goes only to cells that the triangle
inequality, relaxed as in the trees, can't exclude.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import settled, to_python

SHARD_ROWS = 4096
LEAF_ROWS = 128
#: Vectors, at most, drawn by a hash of their ids: pivots of cells, and a first bound on the distance of each query's k-th neighbour.
SAMPLE_ROWS = 2048
#: Shards up to which every query is searched in all of them at once.
FEW_SHARDS = 4
_SLACK = 1e-7  # distances are compared as if they were exact to so much: chord() rounds by 1.5e-8 near zero


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows of a and b, from the vectors as they are."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def chord(dots: np.ndarray) -> np.ndarray:
    """The distance of unit vectors, a metric that falls as their cosine rises."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


class Tree:
    """A vantage-point tree over the distinct vectors of one shard.

    Each inner node has a vantage point, the median distance to it, and halves within and beyond. A
    query that knows k neighbours within distance t need not enter a half whose points must all be
    farther than factor * t by the triangle inequality. With factor 1 the search is exact; smaller
    factors skip more.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], np.ascontiguousarray(rows[order])
        _, first, same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1])))[:, 0], return_index=True, return_inverse=True)
        self.rows, self.units = rows[first], unit(rows[first])
        by = np.argsort(same, kind="stable")
        parts = np.split(ids[by], np.cumsum(np.bincount(same))[:-1])
        self.ids = [np.unique(p)[: k + 1] for p in parts]  # of equal vectors, more can't be among k
        self.k = k
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(self.rows)))

    def _build(self, members: np.ndarray) -> int:
        if len(members) <= LEAF_ROWS:
            self.nodes.append((members,))
            return len(self.nodes) - 1
        vantage = members[0]
        far = chord(self.units[members] @ self.units[vantage])
        middle = float(np.median(far))
        within = far <= middle
        if within.all():
            within = np.arange(len(members)) < len(members) // 2
        near, beyond = self._build(members[within]), self._build(members[~within])
        self.nodes.append((vantage, near, float(far[within].min()), float(far[within].max()), beyond, float(far[~within].min()), float(far[~within].max())))
        return len(self.nodes) - 1

    def search(self, units: np.ndarray, bound: np.ndarray, factor: float) -> list[np.ndarray]:
        """For each query, the rows of distinct vectors that may hold its k neighbours (and itself)."""
        keep = self.k + 4
        self._q, self._far = units, np.full((len(units), keep), np.inf)
        self._at, self._bound, self._factor = np.full((len(units), keep), -1), bound.copy(), factor
        self._visit(self.root, np.arange(len(units)))
        return [a[a >= 0] for a in self._at]

    def _visit(self, node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        if len(self.nodes[node]) == 1:
            members = self.nodes[node][0]
            far = np.concatenate([self._far[who], chord(self._q[who] @ self.units[members].T)], axis=1)
            at = np.concatenate([self._at[who], np.broadcast_to(members, (len(who), len(members)))], axis=1)
            # all that tie with the (k + 1)-th stay
            tied = int((far <= np.partition(far, self.k, axis=1)[:, [self.k]] + _SLACK).sum(axis=1, where=np.isfinite(far)).max())
            if tied > self._far.shape[1]:
                more = ((0, 0), (0, tied - self._far.shape[1]))
                self._far, self._at = np.pad(self._far, more, constant_values=np.inf), np.pad(self._at, more, constant_values=-1)
            best = np.argpartition(far, self._far.shape[1] - 1, axis=1)[:, : self._far.shape[1]]
            self._far[who], self._at[who] = np.take_along_axis(far, best, 1), np.take_along_axis(at, best, 1)
            # the query itself may be one of those found, so the bound is the (k + 1)-th
            self._bound[who] = np.minimum(self._bound[who], np.partition(self._far[who], self.k, axis=1)[:, self.k])
            return
        vantage, near, near_low, near_high, beyond, beyond_low, beyond_high = self.nodes[node]
        far = chord(self._q[who] @ self.units[vantage])
        least = {child: np.maximum(0.0, np.maximum(far - high, low - far)) for child, low, high in ((near, near_low, near_high), (beyond, beyond_low, beyond_high))}
        first = least[near] <= least[beyond]
        for order, group in (((near, beyond), first), ((beyond, near), ~first)):
            for child in order:
                own = who[group]
                go = least[child][group] <= self._factor * self._bound[own] + _SLACK
                self._visit(child, own[go])


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values as doubles, offsets)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


def _by_width(ids: np.ndarray, flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = np.diff(at)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield rows, flat[(at[:-1][rows, None] + np.arange(w)).ravel()].reshape(len(rows), w)


class Pivots:
    """The drawn vectors of one length, as units; the first `cells` of them are pivots, numbered from `first`."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, cells: int, first: int):
        self.ids, self.units, self.first = ids, unit(rows), first
        self.pivots = self.units[:cells]

    def bounds(self, ids: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
        """The distance of each row's k-th neighbour among the drawn vectors but itself."""
        if len(self.ids) <= k:
            return np.full(len(ids), np.inf)
        far = chord(units @ self.units.T)
        far[ids[:, None] == self.ids] = np.inf
        return np.partition(far, k - 1, axis=1)[:, k - 1]


def _drawn(usable: DataFrame, shard_rows: int) -> dict[int, Pivots]:
    """By length of vectors. The driver gets SAMPLE_ROWS vectors at most."""
    cells = -(-usable.count() // shard_rows)
    drawn = usable.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    out: dict[int, Pivots] = {}
    first = 0
    for width in sorted({len(r.embedding) for r in drawn}):
        own = {r.vec_id: r.embedding for r in drawn if len(r.embedding) == width}
        out[width] = Pivots(np.array(list(own), np.int64), np.array(list(own.values())), cells, first)
        first += len(out[width].pivots)
    return out


def search(vectors: DataFrame, queries: Column, k: int = 5, factor: float = 0.9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest of all vectors (vec_id, embedding) to each row of vectors for which `queries` holds.

    Rows are dealt to the cell of their nearest pivot, and within it to shards of about shard_rows by a hash of vec_id, so equal vectors, however many,
    spread evenly; each shard is one task with one tree, through which its queries stream in blocks. Pivots and first
    bounds come from a sample of SAMPLE_ROWS rows; every row is indexed. With factor 1 the result is exact.

    Returns query_id, rank, vec_id, score (cosine in double precision), nearest first, ties to the smaller
    vec_id; all candidates if fewer than k. Null ids and vectors that are null, empty, zero or hold null or
    non-finite values take no part. A row's own vec_id is no candidate for it; repeated rows count once, and of different vectors with one vec_id the nearest; vectors of
    other lengths than the query's aren't compared. Vectors that differ in length alone tie as far as double precision
    makes their cosines equal, and all that come within rounding are compared. No rows: none. Other columns are ignored.
    """
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.coalesce(queries, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    spark = vectors.sparkSession
    drawn = spark.sparkContext.broadcast(_drawn(usable, shard_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cell, far, bound = np.zeros(len(ids), np.int64), np.full(len(ids), 2.0), np.full(len(ids), np.inf)
            for rows, x in _by_width(ids, *_matrix(batch.column(1))):
                own = drawn.value.get(x.shape[1])
                if own is None:  # vectors of a length that none drawn has: a cell of their own
                    cell[rows] = -x.shape[1]
                    continue
                units = unit(x)
                distance = chord(units @ own.pivots.T)
                nearest = distance.argmin(axis=1)
                cell[rows], far[rows] = own.first + nearest, distance[np.arange(len(rows)), nearest]
                asks = batch.column(2).to_numpy(zero_copy_only=False)[rows]
                bound[rows[asks]] = own.bounds(ids[rows[asks]], units[asks], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(bound)], ["vec_id", "embedding", "is_query", "cell", "far", "bound"])

    placed = settled(to_python(usable, place, "vec_id long, embedding array<double>, is_query boolean, cell long, far double, bound double"), "neighbours-placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"), F.min("far").alias("low"), F.max("far").alias("high")).orderBy("cell").collect()
    cells, first = [], 0
    for r in sizes:  # a row for each pivot, and for each length of vectors that none drawn has
        cells.append((r.cell, first, first + r.shards - 1, r.low, r.high))
        first += r.shards
    shards = max(first, 1)
    of_cell = F.broadcast(spark.createDataFrame(cells, "cell long, first int, last int, low double, high double"))
    located = placed.join(of_cell, "cell")
    spread = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("last") - F.col("first") + 1).cast("int")
    held = located.select(spread.alias("shard"), F.lit(0).alias("part"), "vec_id", "embedding", F.lit(0.0).alias("bound"))
    known = {c[0]: c[1:] for c in cells}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[pa.RecordBatch] = []
        trees: dict[int, Tree] | None = None
        for batch in batches:
            part = batch.column(1).to_numpy()
            start = int(np.searchsorted(part, 1))
            if start:
                index.append(batch.slice(0, start))
            if start < len(part):
                if trees is None:
                    trees = grown(index)
                for first in range(start, len(part), 1024):
                    yield answers(trees, batch.slice(first, min(1024, len(part) - first)))

    def grown(index: list[pa.RecordBatch]) -> dict[int, Tree]:
        if not index:
            return {}
        rows = pa.Table.from_batches(index).combine_chunks()
        ids = rows.column("vec_id").to_numpy()
        return {x.shape[1]: Tree(ids[own], x, k) for own, x in _by_width(ids, *_matrix(rows.column("embedding").chunk(0)))}

    def answers(trees: dict[int, Tree], asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, bound, out = asked.column(2).to_numpy(), asked.column(4).to_numpy(), ([], [], [])
        for own, x in _by_width(ids, *_matrix(asked.column(3))):
            tree = trees.get(x.shape[1])
            if tree is None:
                continue
            for i, q, found in zip(own, x, tree.search(unit(x), bound[own], factor), strict=True):
                score = cosines(np.broadcast_to(q, (len(found), len(q))), tree.rows[found])
                pairs = sorted((-s, int(v)) for s, f in zip(score, found, strict=True) for v in tree.ids[f] if v != ids[i])[:k]
                out[0].extend([int(ids[i])] * len(pairs))
                out[1].extend(v for _, v in pairs)
                out[2].extend(-s for s, _ in pairs)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        """What the shards hold for rows of asked (shard, vec_id, embedding, bound)."""
        both = held.unionByName(asked.withColumn("part", F.lit(1))).repartitionById(shards, F.col("shard")).sortWithinPartitions("part")
        return to_python(both, run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    asking = located.where("is_query")
    if shards <= FEW_SHARDS:  # one search of all costs less than one at home, and another elsewhere
        every = searched(asking.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "embedding", "bound"))
        return every.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    at_home = settled(searched(asking.select(F.explode(F.sequence("first", "last")).alias("shard"), "vec_id", "embedding", "bound")), "neighbours-home")
    reached = at_home.withColumn("rank", nth).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("reached"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, home, bound = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            places: list[list[int]] = [[] for _ in ids]
            for rows, x in _by_width(ids, *_matrix(batch.column(1))):
                own = drawn.value.get(x.shape[1])
                if own is None:
                    continue
                there = [(own.first + j, j) for j in range(len(own.pivots)) if own.first + j in known]
                low, high = (np.array([known[c][i] for c, _ in there]) for i in (2, 3))
                far = chord(unit(x) @ own.pivots[[j for _, j in there]].T)
                go = np.maximum(far - high, low - far) <= (factor * bound[rows])[:, None] + _SLACK
                go &= home[rows][:, None] != np.array([c for c, _ in there])
                for r, c in zip(*np.nonzero(go), strict=True):
                    first, last = known[there[c][0]][:2]
                    places[rows[r]].extend(range(first, last + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound), pa.array(places, pa.list_(pa.int32()))], ["vec_id", "embedding", "bound", "shards"])

    bounded = asking.join(reached.dropDuplicates(["vec_id"]), "vec_id", "left").select("vec_id", "embedding", "cell", F.least("bound", F.coalesce("reached", F.lit(float("inf")))).alias("bound"))
    routed = to_python(bounded, route, "vec_id long, embedding array<double>, bound double, shards array<int>")
    going = settled(routed.select(F.explode("shards").alias("shard"), "vec_id", "embedding", "bound"), "neighbours-going")
    found = at_home if going.isEmpty() else at_home.unionByName(searched(going)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
