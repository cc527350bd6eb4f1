"""Recurrences over ordered series.

in_parts() cuts series into stretches, so that even one symbol's history is dealt to many tasks. linear() covers y[t] = r * y[t-1] + u[t] with window functions alone. fold() is for state that no window
expresses: sorted partitions stream through a small step function, one row at a time.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = 64
#: What an older block still adds, relative to its size, is left out below this.
_NEGLIGIBLE = 1e-18


#: Rows of the stretches that in_parts() deals.
PART_ROWS = 1 << 16


def in_parts(df: DataFrame, halo: int, work: Callable[[DataFrame, list[str]], DataFrame], keys: list[str], order: str = "bar_idx", rows: int | None = None) -> DataFrame:
    """work(df, keys) for stretches of `rows` rows of each series, each with the `halo` rows before it.

    For columns that depend on a row and at most halo rows before it (see reach() for averages that fade). `order` counts rows
    from 0 without gaps; the input columns of work hold no nulls, which would make averages null only to the end of a
    stretch. One exchange deals the stretches, however much work() computes from them.
    """
    rows = max(rows or PART_ROWS, halo, 1)
    part = F.floor(F.col(order) / rows).cast("long")
    again = F.when(F.pmod(F.col(order), F.lit(rows)) >= rows - halo, part + 1)
    dealt = df.withColumn("_part", F.explode(F.array_compact(F.array(part, again))))
    return work(dealt, [*keys, "_part"]).where(part == F.col("_part")).drop("_part")


def stretch(order: str = "bar_idx", rows: int | None = None) -> Column:
    """The number of a row's stretch of its series."""
    return F.floor(F.col(order) / (rows or PART_ROWS)).cast("long")


def running(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, Column]], order: str = "bar_idx", rows: int | None = None, long: bool = True) -> DataFrame:
    """df with, for each name: (kind, value), what a series comes to at each row: the `sum`, `max`, `min` or `last` value that isn't null
    so far, or the `next` row's value. `order` counts the rows of a series from 0 without gaps.

    A scan in two levels: stretches of `rows` rows (PART_ROWS) are tasks of their own, one row for each stretch is scanned by series, and what comes in from
    earlier ones is joined back. Null values are passed over; a series' rows before the first other one get null. With long=False, for callers who
    know that no series has more than a stretch, plain windows give the same.
    """
    if not long:
        whole = Window.partitionBy(*keys).orderBy(order)
        until = whole.rowsBetween(Window.unboundedPreceding, 0)
        plain = {"sum": lambda v: F.sum(v).over(until), "max": lambda v: F.max(v).over(until), "min": lambda v: F.min(v).over(until), "last": lambda v: F.last(v, ignorenulls=True).over(until), "next": lambda v: F.lead(v).over(whole)}
        return df.withColumns({name: plain[kind](value) for name, (kind, value) in wanted.items()})
    part = stretch(order, rows)
    given = {f"_v{k}": value for k, (_, value) in enumerate(wanted.values())}
    dealt = df.withColumns(given | {"_part": part}).repartition(*keys, "_part")  # one exchange for both levels
    inside = Window.partitionBy(*keys, "_part").orderBy(order)
    so_far, earlier, later = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy("_part")
    local, ends, carried, out = {}, [], {}, {}
    for k, (name, (kind, _)) in enumerate(wanted.items()):
        v, own, end, brought = F.col(f"_v{k}"), f"_l{k}", f"_e{k}", f"_c{k}"
        if kind == "next":
            local[own] = F.struct(F.lead(v).over(inside).alias("x"), F.lead(F.lit(1)).over(inside).isNotNull().alias("here"))
            ends.append(F.min_by(v, order).alias(end))
            carried[brought] = F.lead(end).over(later)
            out[name] = F.when(F.col(own)["here"], F.col(own)["x"]).otherwise(F.col(brought))
        elif kind == "last":
            local[own] = F.last(v, ignorenulls=True).over(so_far)
            ends.append(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(end))
            carried[brought] = F.last(end, ignorenulls=True).over(earlier)
            out[name] = F.coalesce(own, brought)
        else:
            fold_, both = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}[kind]
            local[own] = fold_(v).over(so_far)
            ends.append(fold_(v).alias(end))
            carried[brought] = fold_(end).over(earlier)
            out[name] = F.coalesce(both(F.col(own), F.col(brought)), F.col(own), F.col(brought))
    starts = dealt.groupBy(*keys, "_part").agg(*ends).withColumns(carried).select(*keys, "_part", *carried)
    joined = dealt.withColumns(local).join(starts, [*keys, "_part"])
    return joined.withColumns(out).select(*[c for c in df.columns if c not in wanted], *wanted)


def reach(r: float) -> int:
    """Rows after which an average that keeps r of itself has forgotten what was before."""
    return 1 if r <= 0 else math.ceil(math.log(_NEGLIGIBLE) / math.log(r))


def linear(df: DataFrame, terms: dict[str, tuple[Column, Column | float]], keys: list[str], order: str = "bar_idx", slowest: float = 0.999) -> DataFrame:
    """df with, for each name: (u, r) of terms, y[t] = r * y[t-1] + u[t] by rows of `order` within keys, 0 <= r < 1.

    The series is cut into blocks of BLOCK rows. Within a block, y comes from a running sum of u / r**k, which
    stays in range; the last values of the blocks before, as far back as they count, are folded for what the block starts with.
    All of it is windows by keys: one exchange, no join, and none if df is dealt by keys already.
    r may be a column if it never exceeds `slowest`. A null u makes y null from there on. `order` counts
    rows from 0 without gaps.
    """
    kept = df.columns
    place = F.pmod(F.col(order), F.lit(BLOCK))
    rows = df.withColumn("_block", F.floor(F.col(order) / BLOCK).cast("long"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    by_block, so_far = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    given = {}
    for k, (u, r) in enumerate(terms.values()):
        given |= {f"_r{k}": r if isinstance(r, Column) else F.lit(float(r)), f"_u{k}": u.cast("double")}
    rows = rows.withColumns(given)
    names, local, carried, out = range(len(terms)), {}, {}, {}
    for k in names:
        r, u = F.col(f"_r{k}"), F.col(f"_u{k}")
        scaled = F.sum(u * F.pow(F.when(r > 0, r).otherwise(F.lit(1.0)), -place)).over(inside)
        local |= {f"_y{k}": F.when(r > 0, scaled * F.pow(r, place)).otherwise(u), f"_gap{k}": F.max(u.isNull()).over(so_far)}
    rows = rows.withColumns(local)
    for k, (_, r) in enumerate(terms.values()):
        ends = F.when(place == BLOCK - 1, F.coalesce(F.col(f"_y{k}"), F.lit(0.0)))
        carried[f"_before{k}"] = F.collect_list(ends).over(by_block.rangeBetween(-_reach(slowest if isinstance(r, Column) else r), -1))
    rows = rows.withColumns(carried)
    for k, name in enumerate(terms):
        r = F.col(f"_r{k}")
        start = F.aggregate(F.col(f"_before{k}"), F.lit(0.0), _carried(F.pow(r, F.lit(BLOCK))))
        out[name] = F.when(~F.col(f"_gap{k}"), F.col(f"_y{k}") + start * F.pow(r, place + 1))
    return rows.withColumns(out).select(*[c for c in kept if c not in terms], *terms)


def _carried(step: Column) -> Callable[[Column, Column], Column]:
    return lambda a, x: a * step + x


def _reach(r: float) -> int:
    """Blocks whose values may still count."""
    if r <= 0:
        return 1
    return max(1, math.ceil(math.log(_NEGLIGIBLE) / (BLOCK * math.log(r))))


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable, step: Callable, added: str, by_group: bool = False) -> DataFrame:
    """df with the columns `added` (a schema): step(state, values of inputs) gives (state, values of added).

    Rows go to tasks by keys and stream in order; only the state is held, so a series may be longer than
    memory. step is called for each row and should be small. start() makes the first state, or start(values of keys) if by_group.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
    names = [f.name for f in StructType.fromDDL(added).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, series = None, None
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            groups = zip(*[batch.column(at[k]).to_pylist() for k in keys], strict=True)
            out = []
            for group, values in zip(groups, zip(*[batch.column(at[c]).to_pylist() for c in inputs], strict=True), strict=True):
                if group != series:
                    series, state = group, start(group) if by_group else start()
                state, made = step(state, values)
                out.append(made)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(added))]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def sliding_median(df: DataFrame, keys: list[str], order: str, column: str, window: int, out: str) -> DataFrame:
    """df with the median of the last `window` rows' values (fewer at first; null values are passed over), null without any.

    A series' rows stream by; the window's values are held in order, so each row costs one search to put its value in and one to take the oldest out.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, last, held = None, deque(), []
        for batch in batches:
            names = batch.schema.names
            groups = zip(*[batch.column(names.index(k)).to_pylist() for k in keys], strict=True)
            made = []
            for group, value in zip(groups, batch.column(names.index(column)).to_pylist(), strict=True):
                if group != series:
                    series, last, held = group, deque(), []
                last.append(value)
                if value is not None:
                    bisect.insort(held, value)
                if len(last) > window:
                    old = last.popleft()
                    if old is not None:
                        held.pop(bisect.bisect_left(held, old))
                n = len(held)
                made.append(None if not n else held[n // 2] if n % 2 else 0.5 * held[n // 2 - 1] + 0.5 * held[n // 2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], [*names, out])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


#: Rounds after which speculative() leaves a series whose stretches never come to agree to fold().
ROUNDS = 6
#: Stretches whose states the driver holds at once, at most.
MOST_STRETCHES = 100_000


def speculative(df: DataFrame, keys: list[str], order: str, inputs: list[str], start: Callable[[], object], step: Callable, added: str, rows: int | None = None) -> DataFrame:
    """As fold(), for long series in many tasks, where state forgets: from different states the same rows soon lead to the same one.

    Stretches of `rows` rows (PART_ROWS) first run from start(), all at once, and tell the state that they end in. Then each whose predecessor ended in another
    state than it began from runs again from that one; when none has to any more, every stretch begins where the one before ends, so all are what
    fold() gives, to the bit. A stretch that joins its earlier path ends as before, so mostly the second round is the last. After ROUNDS, or with more than
    MOST_STRETCHES, fold() does it. States are compared by their pickled bytes. Series of one stretch, which a job of this call looks for, are folded at once. `order` counts
    the rows of a series from 0 without gaps.
    """
    size = rows or PART_ROWS
    if df.where(F.col(order) >= size).isEmpty():
        return fold(df, keys, [order], inputs, start, step, added)
    part = stretch(order, size)
    own = [*keys, "_part"]
    dealt = df.withColumn("_part", part)
    begun: dict[tuple, bytes] = {}
    ended: dict[tuple, bytes] = {}
    fresh = pickle.dumps(start())
    names = dealt.select(*own).dtypes

    def ends_of(some: DataFrame, states: dict[tuple, bytes]) -> dict[tuple, bytes]:
        """The states in which stretches of `some` end."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, series, state = [], None, None
            for batch in batches:
                at = {n: k for k, n in enumerate(batch.schema.names)}
                groups = zip(*[batch.column(at[k]).to_pylist() for k in own], strict=True)
                for group, values in zip(groups, zip(*[batch.column(at[c]).to_pylist() for c in inputs], strict=True), strict=True):
                    if group != series:
                        if series is not None:
                            found.append((*series, pickle.dumps(state)))
                        series, state = group, pickle.loads(states.get(group, fresh))
                    state, _ = step(state, values)
            if series is not None:
                found.append((*series, pickle.dumps(state)))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in range(len(own) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*own, "state"])

        schema = StructType([*some.select(*own).schema.fields, *StructType.fromDDL("state binary").fields])
        kinds = [f.type for f in to_arrow_schema(schema)]
        done = some.repartition(*own).sortWithinPartitions(*own, order).select(*own, *[c for c in inputs if c not in own]).mapInArrow(run, schema)
        return {tuple(r[: len(own)]): bytes(r[len(own)]) for r in done.collect()}

    from pyspark.sql.pandas.types import to_arrow_schema

    if dealt.select(*own).distinct().limit(MOST_STRETCHES + 1).count() > MOST_STRETCHES:
        return fold(df, keys, [order], inputs, start, step, added)
    again: DataFrame = dealt
    for _ in range(ROUNDS):
        ended |= ends_of(again, begun)
        moved = {}
        for key in ended:
            before = (*key[:-1], key[-1] - 1)
            if key[-1] > 0 and ended[before] != begun.get(key, fresh):
                moved[key] = ended[before]
        if not moved:
            break
        begun |= moved
        wanted = df.sparkSession.createDataFrame(list(moved), ", ".join(f"`{n}` {t}" for n, t in names))
        again = dealt.join(F.broadcast(wanted), own, "left_semi")
    else:
        return fold(df, keys, [order], inputs, start, step, added)
    known = df.sparkSession.sparkContext.broadcast(begun)

    def begin(group: tuple) -> object:
        return pickle.loads(known.value.get(group, fresh))

    return fold(dealt, own, [order], inputs, begin, step, added, by_group=True).drop("_part")
