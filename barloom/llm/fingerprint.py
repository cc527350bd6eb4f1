"""One-permutation MinHash fingerprints with optimal densification and b-bit packing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import partitions, to_python
from barloom.llm.textkernel import U, mix, shingles

BINS = 512
BITS = 4
_ROUNDS = 4096
#: Filled bins up to which an empty bin compares all donors' ranks instead of trying one attempt after the other.
_FEW_FILLED = 64
#: What a task fingerprints at once, at most.
_HELD_CHARS, _HELD_ROWS = 1 << 20, 1000


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    """For each attempt and empty bin, the bin to copy from: a hash of both, the same for all texts."""
    bin_, attempt = np.meshgrid(np.arange(bins, dtype=U), np.arange(1, _ROUNDS + 1, dtype=U))
    return (mix(bin_ * U(0x9E3779B97F4A7C15) + mix(attempt)) >> U(11)).astype(np.int64) % bins


@lru_cache(maxsize=4)
def _rank(bins: int) -> np.ndarray:
    """For each empty bin and donor, the first attempt that names the donor; of donors that none names, the next bin is first."""
    bin_ = np.arange(bins)
    out = _ROUNDS + (bin_[None, :] - bin_[:, None]) % bins
    for attempt in range(_ROUNDS - 1, -1, -1):
        out[bin_, _donors(bins)[attempt]] = attempt
    return out.astype(np.int32)


def _densified(low: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Minima by text and bin, those of empty bins copied from the filled bin that is first by _rank()."""
    bins, out, have = low.shape[1], low.copy(), filled.sum(axis=1)
    for r in np.flatnonzero((have > 0) & (have <= _FEW_FILLED)):
        full, empty = np.flatnonzero(filled[r]), np.flatnonzero(~filled[r])
        out[r, empty] = low[r, full[np.argmin(_rank(bins)[empty[:, None], full], axis=1)]]
    row, empty = np.nonzero(~filled & (have > _FEW_FILLED)[:, None])
    for donors in _donors(bins):  # with many filled bins, few attempts are needed
        if not len(row):
            break
        donor = donors[empty]
        good = filled[row, donor]
        out[row[good], empty[good]] = low[row[good], donor[good]]
        row, empty = row[~good], empty[~good]
    for r, e in zip(row, empty, strict=True):
        full = np.flatnonzero(filled[r])
        out[r, e] = low[r, full[np.argmin(_rank(bins)[e, full])]]
    return out


def fingerprints(texts: list[str], bins: int = BINS, bits: int = BITS) -> list[str]:
    """Hex of each text's packed fingerprint; of a text without words, the empty string.

    Every shingle of five words (of fewer words: their whole sequence) is hashed once: some bits name
    its bin, the others compete for the bin's minimum. An empty bin takes the minimum of a filled bin
    that hashes of (bin, attempt) find. Of each bin the lowest `bits` bits are kept, packed. bins: a power of two.
    """
    coded = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    found, at = shingles(np.frombuffer(b"".join(coded), np.uint8), offsets)
    none = np.iinfo(U).max
    low = np.full(len(texts) * bins, none, U)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    shift = U(64 - int(bins).bit_length() + 1)
    np.minimum.at(low, owner * bins + (found >> shift).astype(np.int64), found & ((U(1) << shift) - U(1)))
    low = low.reshape(len(texts), bins)
    filled = low != none
    code = (mix(_densified(low, filled)) & U((1 << bits) - 1)).astype(np.uint8)
    packed = np.packbits(((code[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).reshape(len(texts), -1), axis=1)
    have = filled.any(axis=1)
    return [p.tobytes().hex() if h else "" for p, h in zip(packed, have, strict=True)]


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """The estimated Jaccard similarity of two fingerprints' shingle sets, 0 to 1.

    Bins that differ agree in their low bits by chance once in 2**bits; that share is taken out.
    Equal fingerprints, those of two texts without words too: 1; of one text without words: 0.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(s), np.uint8)).reshape(-1, bits) for s in (a, b))
    same, chance = float((x == y).all(axis=1).mean()), 0.5**bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """text, its last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_HASHES = 1 << 64


def _cuts(quantiles: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges begin, as (key, least hash of the text), in order. Quantiles that fall on one key, as of null or much
    repeated ids, cut the rows of that key by the hashes of their texts."""
    keys, times = np.unique(np.array(quantiles, np.float64).astype(np.int64), return_counts=True)
    least = [k * _HASHES // int(n) - _HASHES // 2 for n in times for k in range(int(n))]
    return np.repeat(keys, times), np.array(least, np.int64)


def _range_of(cuts: tuple[np.ndarray, np.ndarray], keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each row's range, counted from the largest key."""
    below = np.searchsorted(cuts[0], keys, side="left")
    upto = np.searchsorted(cuts[0], keys, side="right")
    for at in np.unique(below[upto > below]):
        rows = np.flatnonzero((below == at) & (upto > below))
        upto[rows] = at + np.searchsorted(cuts[1][at : upto[rows[0]]], hashes[rows], side="right")
    return len(cuts[0]) - upto


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) laid out so that each stands just before its successor.

    Successors go by descending doc_id (null last), equal ids by the descending hash of their texts, then text; after the last the first. The
    rows are dealt by ranges of (doc_id, hash), and the first row of each range also goes, marked `border`,
    behind the range before it: texts are shuffled once and no task sees more than its range. The
    driver holds one boundary and one first row's id and hash for each range.
    """
    n = partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), key.alias("key"), F.xxhash64(text).alias("hash"))
    cuts = _cuts(sorted(rows.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n)) if n > 1 else [])

    @F.pandas_udf("long")
    def part(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(_range_of(cuts, keys.to_numpy(), hashes.to_numpy()))

    found = sorted(rows.select("key", "hash", part("key", "hash").alias("part")).groupBy("part").agg(F.max(F.struct("key", "hash")).alias("first")).collect())
    before = {tuple(first): found[k - 1][0] for k, (_, first) in enumerate(found)}
    firsts = pd.DataFrame([(*row, k) for row, k in before.items()], columns=["key", "hash", "range"]).astype("int64")

    @F.pandas_udf("long")
    def border(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        rows = pd.DataFrame({"key": keys.to_numpy(), "hash": hashes.to_numpy()})
        return rows.merge(firsts, "left", ["key", "hash"])["range"].astype("Int64")

    places = F.array(F.struct(part("key", "hash").alias("part"), F.lit(0).alias("border")), F.struct(border("key", "hash").alias("part"), F.lit(1).alias("border")))
    dealt = rows.withColumn("place", F.explode(places)).select("doc_id", "text", "key", "hash", "place.part", "place.border").where("part is not null")
    return dealt.repartitionById(len(cuts[0]) + 1, F.col("part").cast("int")).sortWithinPartitions("border", F.desc("key"), F.desc("hash"), "text").drop("part", "key", "hash")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts of docs (doc_id, text) and of their edited texts.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.
    Null text: empty. Repeated rows: each has its own result, and equal ones may follow each other.
    Rows with null ids come last. One row follows itself. No rows: none. Other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if wait and wait[-1][2]:
                    continue  # of rows that share the next range's first id, the first counts
                wait.append(row)
                size += len(row[1])
                if len(wait) > _HELD_ROWS or size >= _HELD_CHARS and len(wait) > 1:
                    yield results(wait)
                    wait = wait[-1:]
                    size = len(wait[0][1])
        if len(wait) > 1:
            yield results(wait)

    def results(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        found = fingerprints(texts + changed)
        own, other = found[: len(texts)], found[len(texts) :]
        columns = [
            pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(changed, pa.string()), pa.array(own[:-1], pa.string()), pa.array(other, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return to_python(with_next(docs.select("doc_id", "text")), run, schema)
