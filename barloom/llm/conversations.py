"""Repair of the structure of conversations by a rank-compressed dynamic program.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant turns. Each turn is
kept, given another role, or deleted, and turns may be inserted anywhere; the cheapest edits are wanted, and of these the
ones whose initials (D, I, K, R) spell the least string.

A macro edit is a run of inserts and the turn's own edit: I...I then D, K or R. Such codes are prefix-free, so of two sequences of
as many codes the first different one decides which string is less. So a layer of the program needs no strings: for each of the four states (nothing yet,
and after s, u or a) it holds a cost and the rank of its string among the layer's, and the next layer's ranks follow from (rank before, code).
Costs are taken relative to the least one, so there are few different layers; what follows a layer by a kind of turn is worked out once and
then looked up. A conversation leaves one number a turn, from which the edits are traced back.

Long conversations are cut into stretches. A stretch is passed from each of the four states; a scan over the stretches' costs
and ranks says in which states the best edits enter and leave each, and then each traces its own.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import settled, small, to_python

#: Costs of edits, fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an insert or a new role leads to: the one turn that may follow, but for a system turn, which only a kept one gives.
_NEXT = (USER, USER, ASSISTANT, USER)
#: A state that costs so much more than the cheapest one leads to nothing: two inserts lead on to every turn that it allows, and the system turn
#: that only NOTHING could still keep can be deleted.
_FAR = 2 * INSERT + DELETE
#: States of a whole conversation, and the inserts that lead to one.
_TAILS = ((NOTHING, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2))
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Turns of a conversation, and characters of its texts, up to which it is worked through at once.
LONG_TURNS, LONG_CHARS = 4096, 1 << 23
_ROWS = "conv_id long, place long, edit string, fault string, turn long, was string, role string, text string"


class Kind(NamedTuple):
    """What of a turn its edits depend on."""

    initial: str
    truncated: bool
    bad: bool  # blank or duplicate, to be deleted


class Layer(NamedTuple):
    """By state, the cost beyond the least one (None: out of reach) and the rank of the best edits' string among those of the layer."""

    costs: tuple[int | None, ...]
    ranks: tuple[int, ...]


def starting(state: int) -> Layer:
    return Layer(tuple(0 if s == state else None for s in range(4)), (0, 0, 0, 0))


@lru_cache(maxsize=None)
def _macros(kind: Kind) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, code) of each macro edit of a turn. Longer runs of inserts only come back to states passed."""
    out = []
    for before in range(4):
        at = before
        for run in range(3):
            paid, code = INSERT * run, "I" * run
            out.append((before, at, paid + DELETE, code + "D"))
            if not kind.bad:
                left = TRUNCATED * kind.truncated
                out.append((before, _NEXT[at], paid + REROLE + left, code + "R"))
                if kind.initial == "s" and at == NOTHING:
                    out.append((before, SYSTEM, paid + left, code + "K"))
                if kind.initial == "ua"[_NEXT[at] - USER]:
                    out.append((before, _NEXT[at], paid + left, code + "K"))
            at = _NEXT[at]
    return tuple(out)


@lru_cache(maxsize=None)
def follow(layer: Layer, kind: Kind) -> tuple[Layer, int, tuple]:
    """The layer after a turn, what its costs are taken relative to, and by state (state before, code)."""
    best: list[tuple | None] = [None] * 4
    for before, after, cost, code in _macros(kind):
        if layer.costs[before] is not None:
            found = (layer.costs[before] + cost, layer.ranks[before], code, before)
            if best[after] is None or found < best[after]:
                best[after] = found
    base = min(b[0] for b in best if b is not None)
    best = [None if b is None or b[0] - base > _FAR else b for b in best]
    order = sorted({b[1:3] for b in best if b is not None})
    ranks = tuple(0 if b is None else order.index(b[1:3]) for b in best)
    return Layer(tuple(None if b is None else b[0] - base for b in best), ranks), base, tuple(None if b is None else (b[3], b[2]) for b in best)


class Passage:
    """A stretch of turns passed from one layer on."""

    _steps: dict[tuple, int] = {}
    _pointers: list[tuple] = []

    def __init__(self, first: Layer):
        self.layer, self.cost, self.steps = first, 0, array("l")

    def add(self, kind: Kind) -> None:
        self.layer, base, pointers = follow(self.layer, kind)
        self.cost += base
        number = self._steps.get(pointers)
        if number is None:
            number = self._steps[pointers] = len(self._pointers)
            self._pointers.append(pointers)
        self.steps.append(number)

    def cost_to(self, state: int) -> int | None:
        extra = self.layer.costs[state]
        return None if extra is None else self.cost + extra

    def codes(self, state: int) -> list[str]:
        """The macro edits that lead to the state, one for each turn."""
        out = []
        for number in reversed(self.steps):
            state, code = self._pointers[number][state]
            out.append(code)
        return out[::-1]


def ending(cost_of, rank_of) -> tuple[int, int]:
    """(state of the last turn, inserts after it) of the cheapest whole conversation, the least string on a tie."""
    found = [(cost_of(s) + INSERT * run, rank_of(s), s, run) for s, run in _TAILS if cost_of(s) is not None]
    _, _, state, run = min(found)
    return state, run


def edited(codes: list[str], turns: Iterator[tuple], state: int, place: int) -> Iterator[tuple]:
    """(place, edit, fault, turn, was, role, text) of each edit, of turns (turn, role, text, fault), from a state and place on."""
    for code, (turn, role, text, fault) in zip(codes, turns, strict=True):
        for edit in code:
            now = role if edit == "K" else None
            if edit in "IR":
                state = _NEXT[state]
                now = _ROLE[state]
            elif edit == "K":
                state = "_sua".index(role[0])
            if edit == "I":
                yield place, "I", None, None, None, now, ""
            else:
                yield place, edit, fault, turn, role, now, text
            place += 1


def inserted(run: int, state: int, place: int) -> Iterator[tuple]:
    for k in range(run):
        state = _NEXT[state]
        yield place + k, "I", None, None, None, _ROLE[state], ""


_SPACE = "\\x20\\x09-\\x0D"
_BLANKS = " \t\n\x0b\f\r"


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns (nulls of role and text: one space), whether text is blank, and whether it is truncated."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    last = F.right(F.rtrim(text, F.lit(_BLANKS)), F.lit(1))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (~text.rlike(f"[^{_SPACE}]")).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
    )


def _sorted_by() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]


def repair(turns: DataFrame, long_turns: int = LONG_TURNS) -> DataFrame:
    """The cheapest edits of each conversation of turns (conv_id, turn, role, text), one row each.

    conv_id, place (from 0), edit (D, I, K, R), fault (blank, duplicate, truncated or null), turn and was (the turn's number and role; null of an
    insert), role and text of the repaired turn (a deleted turn has no role and its text).

    Turns go by number, nulls first, then role and text, so repeated rows stand together and all but the first are duplicates. Null roles and texts are one
    space. A role's first character is its initial; a role without one can't be kept. Rows with a null conv_id are one conversation. Keeping costs 0,
    a new role 3, deleting 4 (a must for blank and duplicate turns), inserting an empty user or assistant turn 3, a truncated turn that stays 3 more.
    Equal costs: the least string of edits. No rows: none. Other columns are ignored.

    A conversation of up to long_turns turns and LONG_CHARS characters is held by one task; longer ones are cut into stretches.
    """
    rows = marked(turns)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    long = settled(sizes.where((F.col("turns") > long_turns) | (F.col("chars") > LONG_CHARS)).select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long")), "conversations-long")
    if long.isEmpty():
        return to_python(_together(rows), repaired_whole, _ROWS)
    told = rows.join(small(long), F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
    short = told.where("is_long is null").select(*rows.columns)
    return to_python(_together(short), repaired_whole, _ROWS).unionByName(_by_stretches(told.where("is_long").select(*rows.columns)))


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *_sorted_by())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, row as a tuple) of each row; key is the row's first value."""
    for batch in batches:
        yield from ((r[0], r[1:]) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))


def _written(rows: Iterator[tuple], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of _ROWS in batches."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*((n, kinds[t]) for n, t in (c.split() for c in _ROWS.split(", "))), strict=True)
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or "")
        if len(held) == most or size > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=list(names))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=list(names))


def repaired_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repair() of conversations that stand together and in order (conv_id, turn, role, text, blank, truncated)."""
    yield from _written(_whole(batches))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held: list[tuple] = []
    key, some = None, False
    for now, row in _groups(batches):
        if some and now != key:
            yield from _one(key, held)
            held = []
        key, some = now, True
        held.append(row)
    if some:
        yield from _one(key, held)


def _one(key: int | None, rows: list[tuple]) -> Iterator[tuple]:
    passage, seen, turns = Passage(starting(NOTHING)), set(), []
    for turn, role, text, blank, truncated in rows:
        again = (role, text) in seen
        seen.add((role, text))
        passage.add(Kind(role[:1], truncated, blank or again))
        turns.append((turn, role, text, "blank" if blank else "duplicate" if again else "truncated" if truncated else None))
    state, run = ending(passage.cost_to, lambda s: passage.layer.ranks[s])
    place = 0
    for row in edited(passage.codes(state), iter(turns), NOTHING, 0):
        place = row[0] + 1
        yield key, *row
    for row in inserted(run, state, place):
        yield key, *row


def _by_stretches(rows: DataFrame) -> DataFrame:
    """repair() of long conversations: only roles, kinds and digests of their turns are sorted, and texts are joined at the end."""
    digest = F.sha2(F.encode(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), "UTF-8"), 256)
    named = settled(rows.withColumn("digest", digest), "conversations-turns")
    counted = named.groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    # nulls come first, so the least of (whether there is a turn, turn) is where a text stands first
    firsts = named.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    light = counted.join(firsts, same).select("conv_id", "turn", "role", "digest", "n", "blank", "truncated", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"))
    # different texts of one turn go by text, so for these alone texts are sorted as well
    heads = named.select("conv_id", "turn", "digest", "text").groupBy("conv_id", "turn", "digest").agg(F.first("text").alias("text"))
    by_key = F.col("conv_id").eqNullSafe(F.col("k_conv")) & F.col("turn").eqNullSafe(F.col("k_turn")) & (F.col("digest") == F.col("k_digest"))
    ties = counted.groupBy("conv_id", "turn").agg(F.count("*").alias("several")).where("several > 1").select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn"))
    at_ties = heads.join(ties, F.col("conv_id").eqNullSafe(F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")), "left_semi")
    tied = at_ties.select(F.col("conv_id").alias("k_conv"), F.col("turn").alias("k_turn"), F.col("digest").alias("k_digest"), F.col("text").alias("tie"))
    light = light.join(tied, by_key, "left").select("conv_id", "turn", "role", "tie", "digest", "n", "blank", "truncated", "again")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "tie", "digest"]
    cut = light.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumns({"stretch": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    cut = settled(cut, "conversations-cut")
    fields = ["conv_id", "stretch", "turn", "role", "digest", "n", "blank", "truncated", "again"]
    stretches = cut.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "at").select(*fields)
    passed = settled(to_python(stretches, _passed, "conv_id long, stretch int, costs array<long>, ranks array<int>"), "conversations-passed")
    ways = settled(passed.groupBy("conv_id").applyInArrow(_ways, "conv_id long, stretch int, enter int, leave int, tail int"), "conversations-ways")
    ways = ways.select(F.col("conv_id").alias("w_conv"), F.col("stretch").alias("w_stretch"), "enter", "leave", "tail")
    joined = cut.join(small(ways), F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("stretch") == F.col("w_stretch")))
    again = joined.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "at").select(*fields, "enter", "leave", "tail")
    edits = settled(to_python(again, _traced, "conv_id long, stretch int, k long, edit string, fault string, turn long, was string, role string, digest string"), "conversations-edits")
    sizes = edits.groupBy("conv_id", "stretch").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    starts = sizes.select(F.col("conv_id").alias("s_conv"), F.col("stretch").alias("s_stretch"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    placed = edits.join(small(starts), F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("stretch") == F.col("s_stretch")))
    texts = heads.select(F.col("conv_id").alias("k_conv"), F.col("turn").alias("k_turn"), F.col("digest").alias("k_digest"), "text")
    full = placed.join(texts, by_key, "left")
    return full.select("conv_id", (F.col("start") + F.col("k")).alias("place"), "edit", "fault", "turn", "was", F.col("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def _kinds(row: tuple) -> Iterator[tuple[Kind, str | None]]:
    """Kind and fault of each of the n copies that a row (turn, role, digest, n, blank, truncated, again) stands for."""
    _, role, _, n, blank, truncated, again = row
    for k in range(n):
        copy = again or k > 0
        yield Kind(role[:1], truncated, blank or copy), "blank" if blank else "duplicate" if copy else "truncated" if truncated else None


def _by_stretch(batches: Iterator[pa.RecordBatch], use) -> Iterator[tuple]:
    """use(conv_id, stretch, rows) of each stretch, whose rows stand together."""
    held: list[tuple] = []
    key: tuple | None = None
    for conv, row in _groups(batches):
        if key is not None and (conv, row[0]) != key:
            yield from use(*key, held)
            held = []
        key = (conv, row[0])
        held.append(row[1:])
    if key is not None:
        yield from use(*key, held)


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By stretch, costs and ranks of going through it, by state before and state after (-1: no way)."""

    def use(conv, stretch, rows):
        ways = [Passage(starting(s)) for s in range(4)]
        for row in rows:
            for kind, _ in _kinds(row):
                for way in ways:
                    way.add(kind)
        costs = [[-1 if (c := way.cost_to(s)) is None else c for s in range(4)] for way in ways]
        yield conv, stretch, sum(costs, []), [r for way in ways for r in way.layer.ranks]

    for out in _by_stretch(batches, use):
        yield pa.RecordBatch.from_arrays([pa.array([out[0]], pa.int64()), pa.array([out[1]], pa.int32()), pa.array([out[2]], pa.list_(pa.int64())), pa.array([out[3]], pa.list_(pa.int32()))], names=["conv_id", "stretch", "costs", "ranks"])


def _ways(rows: pa.Table) -> pa.Table:
    """In which states the best edits of a conversation enter and leave each stretch; tail: the inserts at its end. A row for each stretch."""
    own = sorted(rows.to_pylist(), key=lambda r: r["stretch"])
    layers: list[list[tuple | None]] = [[(0, 0, -1) if s == NOTHING else None for s in range(4)]]
    for r in own:
        now: list[tuple | None] = [None] * 4
        for before, held in enumerate(layers[-1]):
            for after in range(4):
                cost = r["costs"][4 * before + after]
                if held is not None and cost >= 0:
                    found = (held[0] + cost, (held[1], r["ranks"][4 * before + after]), before)
                    if now[after] is None or found < now[after]:
                        now[after] = found
        order = sorted({x[1] for x in now if x is not None})
        layers.append([None if x is None else (x[0], order.index(x[1]), x[2]) for x in now])
    state, tail = ending(lambda s: None if layers[-1][s] is None else layers[-1][s][0], lambda s: layers[-1][s][1])
    out = []
    for k in range(len(own) - 1, -1, -1):
        enter = layers[k + 1][state][2]
        out.append((own[k]["conv_id"], own[k]["stretch"], enter, state, tail if k == len(own) - 1 else 0))
        state = enter
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "stretch", "enter", "leave", "tail"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each stretch, numbered from 0."""

    def use(conv, stretch, rows):
        enter, leave, tail = rows[0][-3:]
        way = Passage(starting(enter))
        turns = []
        for row in rows:
            for kind, fault in _kinds(row[:-3]):
                way.add(kind)
                turns.append((row[0], row[1], row[2], fault))
        k = 0
        for row in edited(way.codes(leave), iter(turns), enter, 0):
            k = row[0] + 1
            yield conv, stretch, *row
        for row in inserted(tail, leave, k):
            yield conv, stretch, *row

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["conv_id", "stretch", "k", "edit", "fault", "turn", "was", "role", "digest"]
    held: list[tuple] = []
    for out in _by_stretch(batches, use):
        held.append(out)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


_LEGAL = {"su", "ua", "au"}


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of repair()'s rows, which stand together and in order of place. Texts stream through; the string of edits is held."""
    kinds = (pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string())
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    some, key = False, None

    def row() -> tuple:
        gaps = last - first + 1 - distinct if distinct else 0
        return key, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), hashed.hexdigest()

    out: list[tuple] = []
    for now, (_, edit, fault, turn, was, role, text) in _groups(batches):
        if not some or now != key:
            if some:
                out.append(row())
            some, key = True, now
            faults, illegal, cost, audit, hashed, before = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, [], hashlib.sha256(), None
            first = last = None
            distinct, empty = 0, True
        audit.append(edit)
        cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault is not None:
            faults[fault] += 1
        if edit != "I":
            if turn is not None and turn != last:
                distinct, last = distinct + 1, turn
                first = turn if first is None else first
            if before is not None:
                illegal += before[:1] + was[:1] not in _LEGAL
            before = was
        if edit != "D":
            hashed.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if some:
        out.append(row())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def summary(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each distinct conv_id of ids: gaps in its turns' numbers (maxTurn - minTurn + 1 - distinctTurns, of those it has), how many turns are blank, duplicate and truncated, adjacent
    roles that may not be, the cost and the string of the edits in repaired (from repair()), and a digest of the repaired turns.

    A conversation without turns has zeros, an empty string and the digest of nothing. One task streams through each conversation: a digest has an order.
    """
    ordered = repaired.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")
    made = to_python(ordered, told, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    all_of = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    both = all_of.join(made, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns, damaged by crc32 of 'conv_id:turn' modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    [.!?], 3 repeats it, 4 gives it the role user. Nulls of role and text, and in the checksum's input, are one space."""
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(mark("conv_id"), F.lit(":"), mark("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", mark("role").alias("role"), mark("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    new = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return new.withColumn("copy", F.explode("copies")).select("conv_id", "turn", "role", "text")
