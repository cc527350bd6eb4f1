"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles. If two sets of sizes a and b have a
similarity of 0.75 or more, at most (a + b) / 7 shingles are in only one of them. So sets are cut into
D + 1 blocks by a hash of the shingle, D the most such differences within a band of sizes, and the
XOR of a block's hashes is a sketch of it: differences touch D blocks at most, and an untouched block has
equal XORs in both. Pairs are looked for where a block's XOR is equal, and then verified on the sets (see setjoin).

Bands grow by 4/3, so partners are in the same band or the next; each set sends its blocks for both pairs of
bands it is part of. Blocks are SLOTS for each of these: large sets send the first SLOTS of their D + 1 blocks,
small ones repeat the cut with other hashes, the last as far as needed, until SLOTS are full. At the similarity of 0.75 a block is the same
and not empty with a probability of 0.38 or more, so a pair that should be linked is missed
with a probability of at most 0.62 ** SLOTS, about 1e-10; above it, less.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm import setjoin
from barloom.llm.common import settled, slices, small, to_python
from barloom.llm.setjoin import Likeness, sets_of
from barloom.llm.textkernel import PART, U, mix

SLOTS = 48
#: Five words, a similarity of 0.75 or more.
LIKE = Likeness(5, 75)


def _bands(top: int) -> np.ndarray:
    """Lower ends of the bands of sizes: partners of a size in one band are in it or the next."""
    ends = [1]
    while ends[-1] <= top:
        ends.append(max(ends[-1] + 1, 4 * (ends[-1] - 1) // 3 + 1))
    return np.array([*ends, max(ends[-1] + 1, 4 * (ends[-1] - 1) // 3 + 1)])


_ENDS = _bands(1 << 40)


def block_keys(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The keys of each set's blocks: hashes of (bands, number of the block, XOR of the block)."""
    n = np.diff(at)
    band = np.searchsorted(_ENDS, n, side="right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    keys, sides = [], []
    for lower in (band, band - 1):  # the pair of bands (lower, lower + 1)
        blocks = np.where((lower >= 0) & (n > 0), 2 * (_ENDS[np.maximum(lower, 0) + 2] - 1) // 7 + 1, 1)
        repeats = np.where(blocks > 1, -(-SLOTS // blocks), 0)
        xors = np.zeros(len(n) * SLOTS, U)
        for k, low in itertools.product(range(int(repeats.max(initial=0))), range(0, len(tokens), PART)):
            own, token = owner[low : low + PART], tokens[low : low + PART]
            use = repeats[own] > k
            own, token = own[use], token[use]
            value = mix(token ^ mix(lower[own].astype(U) * U(64) + U(k)))
            block = ((value >> U(32)) * blocks[own].astype(U)) >> U(32)
            place = k * blocks[own] + block.astype(np.int64)
            near = place < SLOTS
            np.bitwise_xor.at(xors, own[near] * SLOTS + place[near], mix(value[near] + U(k)))
        place = np.tile(np.arange(SLOTS, dtype=U), len(n)) + np.repeat((lower + 2).astype(U) * U(64), SLOTS)
        filled = np.flatnonzero(xors)
        parity = np.repeat(lower & 1, SLOTS)[filled].astype(U)  # tells the two pairs of bands of a set apart
        keys.append(mix(xors[filled] ^ mix(place[filled])) & ~U(1) | parity)
        sides.append(filled // SLOTS)
    side = np.concatenate(sides)
    order = np.argsort(side, kind="stable")
    return np.split(np.concatenate(keys)[order], np.searchsorted(side[order], np.arange(1, len(n)))) if len(n) else []


def join(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, class and component_id of each row of docs (doc_id, text). If exact, no link is left to the
    chance of blocks, at the cost of a quarter of all shingles being dealt instead of SLOTS blocks.

    component_id: the smallest doc_id of all documents that links, 100 * intersection >= 75 * union of the shingle
    sets, reach from this one. Null and empty texts and texts without words have no shingles, no class
    and no links: component_id is their own doc_id. Rows with null ids take part; they never give the component_id
    unless all of a component's are null. Repeated rows each have their row. No rows: none. Other columns are
    ignored. Links between equal sets are not listed, they are one class; so copies, however many, cost one row
    each and are never compared.
    """
    return setjoin.join(docs, LIKE, block_keys, exact)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more), of each component of join() the row with the smallest doc_id.

    Of repeated rows, equal in doc_id and text, one stays; documents without shingles all stay but for such
    repeats. Rows that share an id but not their text are judged one by one, each by its set of shingles. Rows with
    null ids go where their component has an id or a smaller set; each different text of what is left stays. No rows: none.
    """
    rows = settled(join(docs), "jaccard-components")
    first = rows.where("class is not null").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("first"))
    again = rows.where("class is not null").join(first, F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("class") == F.col("first.class")), "left_anti")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("repeated"))
    # where ids tell rows apart, the ids of copies are enough
    dropped = small(again.where("doc_id is not null").select(F.col("doc_id").alias("dropped")).distinct())
    if repeated.isEmpty():
        return docs.join(dropped, docs["doc_id"] == dropped["dropped"], "left_anti")
    repeated = settled(repeated, "jaccard-repeated")
    twice = docs["doc_id"].eqNullSafe(repeated["repeated"])
    single = docs.join(repeated, twice, "left_anti").join(dropped, docs["doc_id"] == dropped["dropped"], "left_anti")
    kept = docs.join(repeated, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(_without(kept, again.select("doc_id", "class").distinct()))


def _without(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs without the rows whose id and class are in again."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            _, at, sets = sets_of(data, offsets, LIKE.words)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sets.view(np.int64), pa.int64(), mask=np.diff(at) == 0)], [*rows.schema.names, "class"])

    classed = to_python(whole, run, StructType([*whole.schema.fields, StructField("class", LongType())]))
    copies = again.select(F.col("doc_id").alias("id_again"), F.col("class").alias("class_again"))
    return classed.join(copies, F.col("doc_id").eqNullSafe(F.col("id_again")) & (F.col("class") == F.col("class_again")), "left_anti").select("row.*")
