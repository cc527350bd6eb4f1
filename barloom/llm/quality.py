"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settled, slices, small, summed, to_python
from barloom.llm.textkernel import counts, runs, span_hashes, words

TERMS = 1 << 14
WIDTH = 64
_NONZERO = 8
#: Terms whose sums go together from task to task.
_BLOCK = 32
#: Labelled rows that the network learns from, at most (about): a sample by hash of doc_id and text.
SAMPLE_ROWS = 12_000
#: Tasks that sum context vectors, at most: each sends a table of TERMS vectors.
SUMMING_TASKS = 4096
#: Words that are worked on at once.
_PART = 1 << 16
#: Words whose vectors are gathered at once: 1 MB, which stays in a core's cache.
_GATHERED = 1 << 12

_CLASS = np.zeros(256, np.uint8)  # the byte that stands for a byte in a word's shape
_CLASS[:] = np.arange(256)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_COLLAPSES = np.isin(_CLASS, (97, 65, 48))


def index_vectors() -> np.ndarray:
    """A sparse random vector of -1, 0 and 1 for each term bucket, from a fixed seed."""
    draw = np.random.default_rng(7)
    out = np.zeros((TERMS, WIDTH), np.float32)
    at = np.argsort(draw.random((TERMS, WIDTH)), axis=1)[:, :_NONZERO]
    out[np.arange(TERMS)[:, None], at] = draw.choice(np.array([-1, 1], np.float32), (TERMS, _NONZERO))
    return out


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its shape, word after word, and the offsets of each text's.

    The shape has one a, A or 0 for a run of small letters, capitals or digits, and other bytes as they are.
    """
    spans = words(data, offsets)
    return _terms(data, offsets, spans, span_hashes(data, *spans))


def _terms(data: np.ndarray, offsets: np.ndarray, spans: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """terms(), of words whose spans and hashes, own, are known."""
    starts, ends = spans
    kind = _CLASS[data]
    keep = ~_COLLAPSES[data]
    keep[1:] |= kind[1:] != kind[:-1]
    keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hashes(kind[keep], before[starts], before[ends], fold_case=False)
    half = np.uint64(51)
    out = np.empty(2 * len(own), np.int64)
    out[0::2] = (own >> half).astype(np.int64)  # words have the lower half of the buckets
    out[1::2] = (shape >> half).astype(np.int64) + TERMS // 2
    return out, np.concatenate([[0], np.cumsum(2 * counts(offsets, starts))])


def _sums(vectors: np.ndarray, term: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of the terms' vectors of each text, a part of the terms at a time."""
    out = np.zeros((len(at) - 1, vectors.shape[1]), np.float32)
    for low in range(0, len(term), _GATHERED):
        high = min(low + _GATHERED, len(term))
        first, last = int(np.searchsorted(at, low, side="right")) - 1, int(np.searchsorted(at, high))
        bounds = np.clip(at[first : last + 1], low, high) - low
        full = np.flatnonzero(np.diff(bounds))
        out[first + full] += np.add.reduceat(vectors.take(term[low:high], axis=0), bounds[full], axis=0)
    return out


@dataclass
class Model:
    vectors: np.ndarray  # of each term bucket
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return pooled(self.vectors, data, offsets)

    def score(self, features: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        w1, b1, w2, b2 = self.layers
        logit = np.tanh((features - self.shift) / self.scale @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(logit[:, 0] / self.temperature, -40, 40)))


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: the mean vector of its words, that of their shapes, and three figures (length,
    share of words that are new in the text, share of lines that are)."""
    spans = words(data, offsets)
    own = span_hashes(data, *spans)
    term, at = _terms(data, offsets, spans, own)
    n = np.maximum(np.diff(at) // 2, 1)[:, None]
    out = [_sums(vectors, term[k::2], at // 2) / n for k in (0, 1)]
    line = np.ones(256, np.uint8)
    line[10] = 0
    lines = runs(data, offsets, line)
    fresh = [_new_share(hashes, counts(offsets, starts)) for hashes, starts in ((own, spans[0]), (span_hashes(data, *lines), lines[0]))]
    return np.concatenate([*out, np.log1p(n), *[f[:, None] for f in fresh]], axis=1).astype(np.float32)


def _new_share(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Of each text's hashes, distinct ones over all (1 without any)."""
    bits = np.uint64(len(per).bit_length())  # the text's number stands above its hashes, so that plain values are sorted
    keys = np.sort(hashes >> bits | np.repeat(np.arange(len(per), dtype=np.uint64) << np.uint64(64 - int(bits)), per))
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    distinct = np.bincount((keys[first] >> np.uint64(64 - int(bits))).astype(np.int64), minlength=len(per))
    return np.where(per > 0, distinct / np.maximum(per, 1), 1.0)


def pair_counts(term: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): how often term a stands one or two places after term b in a text."""
    apart = [(term[k:], term[:-k], text_of[k:] == text_of[:-k]) for k in (1, 2)]
    later, earlier = (np.concatenate([x[i][x[2]] for x in apart]) for i in (0, 1))
    pair, n = np.unique((later * TERMS + earlier).astype(np.uint32), return_counts=True)
    return (pair // TERMS).astype(np.int64), (pair % TERMS).astype(np.int64), n


def _context_sums(texts: DataFrame) -> np.ndarray:
    """For each term, the sum of the index vectors of the two terms before and after it, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((TERMS, WIDTH))
        sparse = np.nonzero(index)[1].reshape(TERMS, _NONZERO), index[index != 0].reshape(TERMS, _NONZERO)
        seen = False
        for _, data, offsets in slices(batches, "text", 1 << 21):
            term, at = terms(data, offsets)
            for low in range(0, len(term), 8 * _PART):
                seen = True
                own = slice(max(low - 2, 0), low + 8 * _PART)  # pairs across the cut; those within the two terms again are taken back
                text_of = np.searchsorted(at, np.arange(own.start, min(own.stop, len(term))), side="right")
                _add(total, sparse, *pair_counts(term[own], text_of), 1)
                if low:
                    _add(total, sparse, *pair_counts(term[low - 2 : low], text_of[:2]), -1)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(TERMS // _BLOCK), pa.int32()), pa.array([total[b : b + _BLOCK].tobytes() for b in range(0, TERMS, _BLOCK)], pa.binary())], ["block", "cells"])

    out = np.zeros((TERMS, WIDTH))
    parts = to_python(texts.coalesce(SUMMING_TASKS), run, "block int, cells binary")
    for block, cells in summed(parts, ["block"]).collect():
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(cells).reshape(-1, WIDTH)
    return out


def _add(total: np.ndarray, sparse: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, n: np.ndarray, sign: int) -> None:
    """Adds to total what the pairs of pair_counts() bring either term; sparse: where index vectors aren't 0, and their values there."""
    for own, other in ((a, b), (b, a)):
        cell, weight = own[:, None] * WIDTH + sparse[0][other], sign * n[:, None] * sparse[1][other]
        total += np.bincount(cell.ravel(), weight.ravel(), minlength=total.size).reshape(total.shape)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Random-indexing vectors: what stands around a term, centred and of length 1, plus its own index."""
    around = _context_sums(texts)
    length = np.linalg.norm(around, axis=1, keepdims=True)
    unit = np.divide(around, length, out=np.zeros_like(around), where=length > 0)
    if (length > 0).any():
        unit[length[:, 0] > 0] -= unit[length[:, 0] > 0].mean(axis=0)
    return (unit + index_vectors() / np.sqrt(_NONZERO)).astype(np.float32)


def _fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 60, decay: float = 3e-4) -> tuple[np.ndarray, ...]:
    """Minimises log loss by Adam, in batches of 256 from a fixed seed."""
    draw = np.random.default_rng(11)
    w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for k in range(rounds):
        order, rate = draw.permutation(len(y)), 3e-3 * (1 - k / rounds) + 1e-5
        for first in range(0, len(y), 256):
            rows = order[first : first + 256]
            a = np.tanh(x[rows] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip((a @ w[2] + w[3])[:, 0], -40, 40))) - y[rows])[:, None] / len(rows)
            back = error @ w[2].T * (1 - a * a)
            grads = [x[rows].T @ back + decay * w[0], back.sum(0), a.T @ error + decay * w[2], error.sum(0)]
            step += 1
            for p, g, mean, square in zip(w, grads, m, v, strict=True):
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                p -= rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors of all rows of docs (doc_id, text), and a network that learns from a sample of about
    sample_rows rows with a label (doc_id, quality).

    The sample is by hash of doc_id and text, so every part of the corpus gives its share and repeated ids don't add to it. Labels that are null
    are left out; of several labels of one doc_id the mean, rounded, counts. Vectors and features are
    made on the executors; the driver fits the network on sample_rows rows of features. Without rows
    of both labels, every score is the share of label 1 (1 without labels).
    """
    per = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    labelled = docs.select("doc_id", "text").join(small(per), "doc_id")
    per_id = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    share = min(1.0, sample_rows / max(docs.select("doc_id").join(small(per), "doc_id", "left_semi").count(), 1))
    sample = settled(labelled.where(per_id < int(share * (1 << 20))).select("doc_id", "text", "quality"), "quality-sample")
    if sample.count() > 2 * sample_rows:  # rows equal in id and text come in or stay out together; then each counts once
        sample = sample.dropDuplicates(["doc_id", "text"])
    vectors = word_vectors(docs.select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            cells = pooled(shared.value, data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([c.tobytes() for c in cells], pa.binary())], ["doc_id", "quality", "cells"])

    found = to_python(sample, run, "doc_id long, quality int, cells binary").orderBy("doc_id", "cells").collect()
    y = np.array([r.quality for r in found], np.float64)
    x = np.stack([np.frombuffer(r.cells, np.float32) for r in found]) if found else np.zeros((0, 2 * WIDTH + 3), np.float32)
    shift = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(axis=0) + 1e-3 if len(x) else np.ones(x.shape[1])
    if len(set(y)) < 2:
        p = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
        return Model(vectors, shift, scale, (np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.array([np.log(p / (1 - p))])), 1.0)
    z, held = (x - shift) / scale, np.arange(len(y)) % 5 == 4
    layers = _fit(z[~held], y[~held])
    logit = (np.tanh(z[held] @ layers[0] + layers[1]) @ layers[2] + layers[3])[:, 0]
    grid = np.exp(np.linspace(np.log(0.5), np.log(10), 60))
    loss = [np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logit / t).mean() for t in grid]
    return Model(vectors, shift, scale, layers, float(grid[int(np.argmin(loss))]))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (of label 1) and predicted (1 if score >= threshold); docs need a column text.

    Null and empty texts are scored as texts without words. Repeated rows stay, with equal scores.
    Columns of docs named score or predicted are replaced (see good()). Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            score = shared.value.score(shared.value.features(data, offsets))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], [*rows.schema.names, "score", "predicted"])

    return to_python(docs.select(*kept), run, schema)


def good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that classify() takes for good."""
    hidden = {c: f"{c}_of_docs" for c in ("score", "predicted") if c in docs.columns}
    while set(hidden.values()) & set(docs.columns):
        hidden = {c: f"{h}_" for c, h in hidden.items()}
    kept = classify(docs.withColumnsRenamed(hidden), model, threshold).where("predicted = 1")
    return kept.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])
