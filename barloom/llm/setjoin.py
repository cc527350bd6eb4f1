"""Links between sets of shingles: candidates by keys, sketches that rule pairs out, and checks on whole sets.

A document is the set of its distinct shingles (see textkernel.shingles), each hashed to 64 bits. Equal sets form a
class; links are sought between classes. What keys a class has is for the operator to say (blocks of parity sketches, or bands of
minhashes); classes that share one are candidates, and these are verified on the sets.

Many classes may share a key, as of a passage that they all quote. Classes of such large groups are not compared
group by group but by those of their shingles that decide (by_shingles()), which also is the exact way for a whole join: nothing there is left to chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import forget, settled, slices, small, to_python
from barloom.llm.components import towards_least
from barloom.llm.textkernel import U, mix, shingles

#: Bits of the parity sketch of a whole set.
SKETCH_BITS = 1024
#: Classes in one key's group up to which all its pairs of different components are listed.
SMALL_GROUP = 48
#: Classes that are compared with as many others at once.
_PACK = 128
#: Heavy shingles that go to all executors, at most; beyond it, they are joined by a shuffle.
MOST_HEAVY = 200_000
#: The keys of each of some sets, of their sorted hashes and offsets.
Keys = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


class Likeness(NamedTuple):
    """When two sets of shingles of `words` words link: 100 * intersection >= percent * union."""

    words: int
    percent: int

    def links(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def sized(self, a, b):
        """Whether sizes a and b allow a link."""
        return (100 * a >= self.percent * b) & (100 * b >= self.percent * a)

    def close(self, apart, total):
        """Whether sets with at least `apart` shingles in one of them alone, of `total` in both, may link."""
        return apart * (100 + self.percent) <= total * (100 - self.percent)

    def deciding(self, n):
        """Of sets that link, so many first shingles in one order have one in common."""
        return n - (self.percent * n + 99) // 100 + 1


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted; their offsets; a hash of each whole set)."""
    found, at = shingles(data, offsets, size)
    parts = [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    out = np.concatenate(parts) if parts else found
    sizes = np.array([len(p) for p in parts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(out + U(1)))])
    return out, at, mix((total[at[1:]] - total[at[:-1]]) ^ mix(sizes.astype(U)))


def parity_sketches(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of SKETCH_BITS / 64 words for each set: every shingle flips one bit, so the Hamming distance
    of two sketches is at most the number of shingles in one of the sets alone."""
    n = np.diff(at)
    words = SKETCH_BITS // 64
    out = np.zeros(len(n) * words, U)
    spot = mix(tokens ^ U(0x5851F42D4C957F2D)) % U(SKETCH_BITS)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(n)), n) * words + (spot >> U(6)).astype(np.int64), U(1) << (spot & U(63)))
    return out.reshape(len(n), words)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def outline(docs: DataFrame, like: Likeness, keys_of: Keys) -> DataFrame:
    """doc_id, n_shingles, class (of equal sets; null for an empty one), sketch, keys of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            tokens, at, whole = sets_of(data, offsets, like.words)
            keys, n = keys_of(tokens, at), np.diff(at)
            lengths = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(n, pa.int64()), pa.array(_signed(whole), pa.int64(), mask=n == 0), pa.array([s.tobytes() for s in parity_sketches(tokens, at)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(_signed(np.concatenate(keys)), pa.int64())),
                ],
                ["doc_id", "n_shingles", "class", "sketch", "keys"],
            )

    return to_python(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_shingles long, class long, sketch binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, like: Likeness, repeated: bool) -> DataFrame:
    """class and set (sorted 64-bit hashes) of the classes of wanted (doc_id, class), from their texts.

    A row for each class: ids tell rows apart, or else, where ids are repeated, classes are made unique by a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches, "text"):
            tokens, at, whole = sets_of(data, offsets, like.words)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(whole), pa.int64()), pa.array([tokens[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["class", "set"])

    ids = wanted.select(F.col("doc_id").alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = to_python(texts.join(small(ids), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text"), run, "class long, set binary")
    if not repeated:
        return rows
    return rows.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Those of pairs (a, b) of classes whose sets link. Only the sets of pairs are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(like.links(both, len(x), len(y)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["a", "b"])

    first, second = (sets.join(small(pairs.select(F.col(c).alias("class"))), "class", "left_semi").select(F.col("class").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    return to_python(first.join(small(pairs), "a").join(second, "b").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def _plausible(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Those of pairs (a, b) that sizes and sketches allow."""
    first, second = (classes.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b"))
    sizes = like.sized(F.col("n_a"), F.col("n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), U).reshape(len(c), SKETCH_BITS // 64) for c in batch.columns[3:])
            near = like.close(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], ["a", "b"])

    joined = pairs.join(first, "a").join(second, "b").where(sizes)
    return to_python(joined.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b"), run, "a long, b long")


def _near(n: np.ndarray, sketch: np.ndarray, x: np.ndarray, y: np.ndarray, like: Likeness) -> np.ndarray:
    """Whether sizes and sketches allow a link of each pair of rows x, y."""
    sized = like.sized(n[x], n[y])
    sized[sized] = like.close(np.bitwise_count(sketch[x[sized]] ^ sketch[y[sized]]).sum(axis=1, dtype=np.int64), (n[x] + n[y])[sized])
    return sized


def _columns(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """class, component, n_shingles, sketch"""
    plain = [rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy() for c in ("class", "component", "n_shingles")]
    return *plain, np.frombuffer(b"".join(rows.column(rows.schema.get_field_index("sketch")).to_pylist()), U).reshape(len(plain[0]), SKETCH_BITS // 64)


def _within_small(members: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of members (key, class, component, n_shingles, sketch) of one key and different components that
    sizes and sketches allow; groups have at most SMALL_GROUP rows and stream by in order of key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if held is None or not len(held) else pa.concat_batches([held, batch])
            key = rows.column(0).to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            yield pairs(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None:
            yield pairs(held)

    def pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
        key = rows.column(0).to_numpy()
        name, component, n, sketch = _columns(rows)
        a, b = [name[:0]], [name[:0]]
        for step in range(1, len(key)):
            x = np.flatnonzero(key[:-step] == key[step:])
            if not len(x):
                break
            x = x[component[x] != component[x + step]]
            x = x[_near(n, sketch, x, x + step, like)]
            a.append(name[x])
            b.append(name[x + step])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return to_python(members.select("key", "class", "component", "n_shingles", "sketch").repartition("key").sortWithinPartitions("key"), run, "a long, b long")


def by_shingles(sets: DataFrame, known: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of classes of sets (class, set) and different components, as known (class, component, n_shingles, sketch) has
    them, that sizes and sketches allow; verified, they join all that the links between those classes join.

    Shingles are put in one order: by hash, but for the heavy ones, that more than SMALL_GROUP of the sets have, which come last, the rarest
    first. Of sets that link, the first deciding() shingles have one in common, so only these are dealt. A set that has a heavy one among them
    consists of heavy shingles, its frame, for `percent` and more, and two such sets that share no other one link by their frames alone.
    So of the sets of one frame the smallest stands for all: every set as small as the frame allows links with it, and the
    others are compared with such smallest ones only.
    """
    firsts = settled(_first_shingles(sets, like).join(small(known.select("class", "component")), "class"), "pairs-firsts")
    light = firsts.where("not is_heavy").select("class", "component", F.explode("tokens").alias("key"))
    mixed = light.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    mixed = settled(mixed, "pairs-groups")
    few = settled(_within_small(light.join(small(mixed), "key").join(known.drop("component"), "class"), like), "pairs-few")
    framed = firsts.where("is_heavy").join(known.drop("component"), "class")
    smallest = settled(framed.groupBy("frame", "heavy").agg(F.min(F.struct("n_shingles", "class", "component")).alias("least")), "pairs-frames")
    placed = framed.join(small(smallest), ["frame", "heavy"]).withColumn("leads", F.col("class") == F.col("least.class"))
    near = (F.col("n_shingles") + F.col("least.n_shingles")) * like.percent <= F.col("heavy") * (100 + like.percent)
    stars = placed.where(near & ~F.col("leads") & (F.col("component") != F.col("least.component"))).select(F.col("class").alias("a"), F.col("least.class").alias("b"))
    others = placed.where(F.col("leads") | ~near).select(F.explode("tokens").alias("key"), "class", "component", "n_shingles", "sketch", "frame", "leads")
    large = settled(others, "pairs-large")
    across = _within_large(large, like)
    found = settled(stars.unionByName(few).unionByName(across), "pairs-found")
    for done in (firsts, mixed, few, smallest, large, across):
        forget(done)
    return found


#: Buckets that shingles are first counted in, by a hash of them: at most; and shingles of one bucket, on average, up to which that tells most of the rare ones.
_MOST_BUCKETS, _FULL = 1 << 22, 24


def _crowded(sets: DataFrame) -> np.ndarray | None:
    """By bucket, whether it holds so many shingles of sets (class, set) that one of them may be heavy; None where there are too many shingles for buckets to tell."""
    total = sets.agg(F.coalesce(F.sum(F.octet_length("set")), F.lit(0))).first()[0] // 8
    if total > _MOST_BUCKETS * _FULL:
        return None
    buckets = 1 << min(_MOST_BUCKETS.bit_length() - 1, max(12, (total // 8).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int32)
        for batch in batches:
            if len(batch):
                tokens = np.concatenate([np.frombuffer(own.as_buffer(), np.int64) for own in batch.column(0)])
                np.add.at(n, tokens & (buckets - 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(n, 255).astype(np.uint8).tobytes()], pa.binary())], ["n"])

    parts = to_python(sets.select("set").coalesce(16), run, "n binary").collect()  # 16 rows of a byte for each bucket
    return sum((np.frombuffer(r.n, np.uint8).astype(np.int32) for r in parts), np.zeros(buckets, np.int32)) > SMALL_GROUP


def _counted(sets: DataFrame, crowded: np.ndarray | None, most: int = 1 << 20) -> DataFrame:
    """token and n, how many of sets (class, set) have it, of tokens in crowded buckets: tasks add up before they send, some `most` shingles at a time."""
    shared = sets.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = shared.value
        known, often, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (known[:0], often[:0])
            every, at = np.unique(np.concatenate([known, new]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([often, n]), minlength=len(every)).astype(np.int64)

        for batch in batches:
            for own in batch.column(0):
                tokens = np.frombuffer(own.as_buffer(), np.int64)
                held.append(tokens if full is None else tokens[full[tokens & (len(full) - 1)]])
                size += len(held[-1])
                if size > most:
                    (known, often), held, size = merged(), [], 0
                    if len(known) > most:
                        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(often)], ["token", "n"])
                        known, often = known[:0], often[:0]
        known, often = merged()
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(often)], ["token", "n"])

    return to_python(sets.select("set"), run, "token long, n long")


def _tokens(sets: DataFrame) -> DataFrame:
    """class and token of each shingle of sets (class, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(own.as_buffer(), np.int64) for own in batch.column(1)]
            if tokens:
                names = np.repeat(batch.column(0).to_numpy(), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(tokens))], ["class", "token"])

    return to_python(sets.select("class", "set"), run, "class long, token long")


def _first_shingles(sets: DataFrame, like: Likeness) -> DataFrame:
    """Of each class of sets (class, set), those shingles that decide, heavy ones (is_heavy) and others in rows of their own, with a hash of all
    its heavy ones, frame, and their number, heavy. All shingles of all sets are counted."""
    counts = settled(_counted(sets, _crowded(sets)).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > SMALL_GROUP), "pairs-heavy")
    if counts.limit(MOST_HEAVY + 1).count() > MOST_HEAVY:
        return _first_by_join(sets, counts, like)
    rows = counts.orderBy("token").collect()
    tokens, often = (np.array([r[c] for r in rows], np.int64) for c in ("token", "n"))
    forget(counts)
    shared = sets.sparkSession.sparkContext.broadcast((tokens, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, n = shared.value
        for batch in batches:
            out: list[tuple] = []
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(own.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
                is_common = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
                light, frame = tokens[~is_common], tokens[is_common]
                frame = frame[np.argsort(n[at[is_common]], kind="stable")] if len(frame) else frame
                deciding = like.deciding(len(tokens))
                hashed = int(np.bitwise_xor.reduce(mix(frame.view(U)))) if len(frame) else 0
                for flag, part in ((False, light[:deciding]), (True, frame[: max(0, deciding - len(light))])):
                    if len(part):
                        out.append((name, flag, part, hashed - (1 << 63), len(frame)))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["class", "is_heavy", "tokens", "frame", "heavy"])

    return to_python(sets.select("class", "set"), run, "class long, is_heavy boolean, tokens array<long>, frame long, heavy long")


def _first_by_join(sets: DataFrame, counts: DataFrame, like: Likeness) -> DataFrame:
    """_first_shingles() for any number of heavy shingles, counts (token, n)."""
    ranked = _tokens(sets).join(counts, "token", "left").groupBy("class").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("own"))
    light, frame = (F.transform(F.filter("own", keep), lambda t: t["token"]) for keep in (lambda t: t["n"] == 0, lambda t: t["n"] > 0))
    hashed = F.aggregate(frame, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.xxhash64(t)))
    n = F.size("own")
    deciding = n - F.floor((n * like.percent + 99) / 100).cast("int") + 1
    told = ranked.select("class", light.alias("light"), frame.alias("common"), hashed.alias("frame"), deciding.alias("deciding"))
    rest = F.greatest(F.col("deciding") - F.size("light"), F.lit(0))
    parts = F.array(F.struct(F.lit(False).alias("is_heavy"), F.slice("light", F.lit(1), F.col("deciding")).alias("tokens")), F.struct(F.lit(True).alias("is_heavy"), F.slice("common", F.lit(1), rest).alias("tokens")))
    return told.select("class", F.explode(parts).alias("part"), "frame", F.size("common").cast("long").alias("heavy")).where(F.size("part.tokens") > 0).select("class", "part.is_heavy", "part.tokens", "frame", "heavy")


def _within_large(members: DataFrame, like: Likeness) -> DataFrame:
    """As _within_small() for groups of any size, of members (key, class, component, n_shingles, sketch, frame, leads) of
    different frames of which one leads.

    Groups are dealt into packs of about _PACK members, those of the most frequent component apart, and each pack of the others
    is compared with all packs: a row holds two packs, so work is dealt evenly, however large a group is. What is found is written to the shared folder.
    """
    tally = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    groups = tally.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    groups = settled(groups.select("key", "top", "all"), "pairs-groups")
    dealt = members.join(small(groups), "key").withColumn("of_top", F.col("component") == F.col("top.component"))
    packs = F.ceil(F.when(F.col("of_top"), F.col("top.n")).otherwise(F.col("all") - F.col("top.n")) / _PACK)
    member = F.struct("class", "component", "n_shingles", "frame", "leads", "sketch")
    packed = dealt.groupBy("key", "of_top", F.pmod(F.xxhash64("class"), packs).alias("pack")).agg(F.collect_list(member).alias("members"), F.max("leads").alias("led"))
    packed = settled(packed, "pairs-packs")
    first, second = (packed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("of_top", "pack", "led", "members")]) for side in ("a", "b"))
    meet = ~F.col("of_top_a") & (F.col("of_top_b") | (F.col("pack_a") <= F.col("pack_b"))) & (F.col("led_a") | F.col("led_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                yield pairs(x.values, y.values)

    def pairs(first: pa.StructArray, second: pa.StructArray) -> pa.RecordBatch:
        both = [pa.concat_arrays([first.field(k), second.field(k)]) for k in range(6)]
        name, component, n, frame, leads = (c.to_numpy(zero_copy_only=False) for c in both[:5])
        sketch = np.frombuffer(b"".join(both[5].to_pylist()), U).reshape(len(name), SKETCH_BITS // 64)
        x, y = (i.ravel() for i in np.meshgrid(np.arange(len(first)), np.arange(len(first), len(name)), indexing="ij"))
        worth = (component[x] != component[y]) & (frame[x] != frame[y]) & (leads[x] | leads[y])
        x, y = x[worth], y[worth]
        good = _near(n, sketch, x, y, like)
        return pa.RecordBatch.from_arrays([pa.array(name[x[good]]), pa.array(name[y[good]])], ["a", "b"])

    found = settled(to_python(first.join(second, "key").where(meet).select("members_a", "members_b"), run, "a long, b long"), "pairs-across")
    for done in (groups, packed):
        forget(done)
    return found


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes_of(full: DataFrame) -> DataFrame:
    """class, row and doc_id (the smallest ones) and n (rows) of each class of full (from outline(docs), with a row number), settled."""
    return settled(full.where("class is not null").groupBy("class").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "pairs-ids")


def links_between_classes(docs: DataFrame, full: DataFrame, ids: DataFrame, like: Likeness, exact: bool = False) -> DataFrame:
    """Links (a, b) of classes of full (from outline(docs)) that join everything that all links join, each once, a < b, written to the shared folder.

    First each class, of ids (classes_of(full)), is compared with one class of each of its keys' groups, the one whose keys have the most
    members in all: the original of many altered copies shares more keys than any copy. What these links
    leave in different components is compared wherever it shares a key, as far as sizes and sketches
    allow: small groups as they stream by, the classes of larger ones by_shingles(). If exact, all classes are compared by_shingles().
    What a step has written is deleted when the steps that read it are over. Frames that only say which rows are wanted may have repeats.
    """
    one = full.where("class is not null").join(small(ids.select("row")), "row", "left_semi")
    repeated = not full.groupBy("doc_id").count().where("count > 1").isEmpty()
    if exact:
        sets = settled(_sets(docs, ids, like, repeated), "pairs-sets")
        alone = settled(one.select("class", F.col("class").alias("component"), "n_shingles", "sketch"), "pairs-classes")
        found = by_shingles(sets, alone, like)
        tried = settled(_once(found), "pairs-tried")
        links = settled(_verified(tried, sets, like), "pairs-links")
        for done in (sets, alone, found, tried):
            forget(done)
        return links
    blocks = one.select("class", F.explode("keys").alias("key"))
    groups = blocks.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = settled(blocks.join(groups, "key"), "pairs-members")
    met = settled(members.groupBy("class").agg(F.sum("size").alias("met")), "pairs-met")
    known = settled(one.select("class", "n_shingles", "sketch").join(small(met), "class"), "pairs-classes")
    hubs = members.join(small(met), "class").groupBy("key").agg(F.max_by("class", F.struct("met", "class")).alias("hub"))
    stars = members.join(hubs, "key").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    tried = settled(_plausible(_once(stars), known, like), "pairs-tried")
    sets = settled(_sets(docs, ids.join(small(_ends(tried)), "class", "left_semi"), like, repeated), "pairs-sets")
    links = settled(_verified(tried, sets, like), "pairs-links")
    found = towards_least(links)
    labelled = members.join(small(found.withColumnRenamed("node", "class")), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = settled(labelled.join(mixed, "key", "left_semi").select("key", "class", "size", "component"), "pairs-open")
    forget(members)
    described = known.select("class", "n_shingles", "sketch")
    more = settled(_once(_within_small(open_.where(F.col("size") <= SMALL_GROUP).join(described, "class"), like)).join(small(tried), ["a", "b"], "left_anti"), "pairs-more")
    many = settled(open_.where(F.col("size") > SMALL_GROUP).groupBy("class").agg(F.min("component").alias("component")).join(described, "class"), "pairs-many")
    later = _ends(more).unionByName(many.select("class")).join(small(_ends(tried)), "class", "left_anti")
    rest = settled(_sets(docs, ids.join(small(later), "class", "left_semi"), like, repeated), "pairs-sets")
    all_sets, done = sets.unionByName(rest), [met, known, tried, sets, open_, more, many, rest, links, found]
    if not many.isEmpty():
        by = by_shingles(all_sets.join(small(many.select("class")), "class", "left_semi"), many, like)
        more = settled(more.unionByName(_once(by).join(small(tried), ["a", "b"], "left_anti")).distinct(), "pairs-more")
        done += [by, more]
    links = settled(links.unionByName(_verified(more, all_sets, like)), "pairs-links")
    for old in done:
        forget(old)
    return links


def _ends(pairs: DataFrame) -> DataFrame:
    """The classes of pairs (a, b), as often as they are there."""
    return pairs.select(F.explode(F.array("a", "b")).alias("class"))


def join(docs: DataFrame, like: Likeness, keys_of: Keys, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, class and component_id of each row of docs (doc_id, text), as jaccard.join() and neardup.join() state."""
    full = settled(outline(docs, like, keys_of).withColumn("row", F.monotonically_increasing_id()), "pairs-outline")
    rows = settled(full.select("doc_id", "n_shingles", "class"), "pairs-rows")
    ids = classes_of(full)
    links = links_between_classes(docs, full, ids, like, exact)
    forget(full)
    parts = towards_least(links)
    named = ids.join(small(parts.withColumnRenamed("node", "class")), "class", "left").withColumn("component", F.coalesce("component", "class"))
    several = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("all")).where("all > 1").drop("all")
    labels = settled(named.join(small(several, within=ids), "component").select(F.col("class").alias("of"), "component_id"), "pairs-labels")
    for done in (ids, links, parts):
        forget(done)
    return rows.join(small(labels), F.col("class") == F.col("of"), "left").select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))
