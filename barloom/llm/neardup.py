"""Near-duplicates by minhashes with tensored banding.

A document is the set of its distinct two-word shingles. A table of locality-sensitive hashing wants a key of four
minhashes. Instead of four for each of 16 tables, a tensor computes four collections of two on one side and four on the
other, and every pair of a collection here and one there makes a key: 16 keys from 16 minhashes instead of 64. The
keys of a tensor depend on each other, so TENSORS of them, with hashes of their own, are formed. At the similarity s one tensor misses a pair with
the probability 1 - (1 - (1 - s**2)**4)**2, which is 0.033 at 0.8, so all four miss it with one of about 1.2e-6; above it, less.
Candidates are verified on their full sets (see setjoin).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import setjoin
from barloom.llm.setjoin import Likeness
from barloom.llm.textkernel import U, mix

#: Two words, a similarity of 0.8 or more.
LIKE = Likeness(2, 80)
#: Tensors; collections on each side of one; minhashes in a collection.
TENSORS, SIDE, DEEP = 4, 4, 2
_SEEDS = mix(np.arange(1, TENSORS * 2 * SIDE * DEEP + 1, dtype=U) * U(0xD1B54A32D192ED03))


def minhashes(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of all minhashes of each set; of an empty set, all ones."""
    n = np.diff(at)
    filled = np.flatnonzero(n)
    out = np.full((len(n), len(_SEEDS)), ~U(0))
    for k, seed in enumerate(_SEEDS):
        value = (tokens ^ seed) * (seed | U(1))
        value ^= value >> U(32)
        value *= U(0xC4CEB9FE1A85EC53)
        if len(filled):
            out[filled, k] = np.minimum.reduceat(value, at[:-1][filled])
    return out


def tensor_keys(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The keys of each set: for each tensor, of each collection on its one side with each on its other; none of an empty set."""
    n = np.diff(at)
    if not len(n):
        return []
    parts = minhashes(tokens, at).reshape(len(n), TENSORS, 2, SIDE, DEEP)
    names = np.zeros(parts.shape[:-1], U)  # one hash for each collection
    for k in range(DEEP):
        names = mix(names ^ mix(parts[..., k] + U(k)))
    first, second = names[:, :, 0, :, None], names[:, :, 1, None, :]
    place = np.arange(TENSORS * SIDE * SIDE, dtype=U).reshape(TENSORS, SIDE, SIDE)
    keys = mix(first ^ mix(second + place)).reshape(len(n), -1)
    return [row if size else row[:0] for row, size in zip(keys, n, strict=True)]


def join(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, class and component_id of each row of docs (doc_id, text). If exact, no link is left to the chance of minhashes.

    component_id: the smallest doc_id of all documents that links, 100 * intersection >= 80 * union of the sets of
    two-word shingles, reach from this one. A text of one word is a set of that word. Null and empty texts and texts without words
    have no shingles, no class and no links: component_id is their own doc_id. Rows with null ids take part; they never
    give the component_id unless all of a component's are null. Repeated rows each have their row. No rows: none. Other
    columns are ignored. Equal sets are one class and are never compared.
    """
    return setjoin.join(docs, LIKE, tensor_keys, exact)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id as join() has them, and kept: whether the row's id is its component's.

    Of repeated ids each row is kept or none is; rows with null ids are kept where their component has no id.
    """
    return join(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
