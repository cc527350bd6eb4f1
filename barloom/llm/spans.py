"""Spans of pattern matches in texts, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,found:string,before:string>"



def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of integers, all numbers up to it folded by step, from 0.

    Arrays grow by copying, so runs are folded within chunks of about the root of the length, and then over the chunks.
    """
    size = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
    last = lambda v: F.coalesce(F.try_element_at(v, F.lit(-1)), F.lit(0))
    fold = lambda v, first: F.aggregate(v, first, lambda out, x: F.array_append(out, step(last(out), x)))
    none = F.array().cast("array<int>")
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), size(v)), lambda k: fold(F.slice(v, k + 1, size(v)), none))
    before = lambda own: F.slice(fold(F.transform(own, last), F.array(F.lit(0))), F.lit(1), F.size(own))
    return let(numbers, lambda v: let(chunks(v), lambda own: F.flatten(F.zip_with(own, before(own), lambda part, start: F.transform(part, lambda x: step(start, x))))))


def matches(text: Column, kind: str, pattern: str, context: int = 0, marks: tuple[str, ...] = ()) -> Column:
    """All leftmost non-overlapping matches as an array of SPAN, in order; empty without any.

    Start and end are code points, end exclusive. What stands between matches comes from splitting
    at the same pattern, so both lists interleave and lengths add up to places. `context` code points
    before each match are kept. pattern must not match the empty string. marks: strings of which every match holds one;
    texts without any are passed over.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def placed(pair: Column, end: Column) -> Column:
        hit, gap = pair["hit"], pair["gap"]
        before = F.substring(gap, F.greatest(F.length(gap) - context + 1, F.lit(1)), F.lit(context)) if context else F.lit("")
        return F.struct(F.lit(kind).alias("kind"), (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("found"), before.alias("before"))

    all_of = let(pairs, lambda own: F.zip_with(own, running(F.transform(own, lambda p: F.length(p["gap"]) + F.length(p["hit"])), lambda a, x: a + x), placed))
    worth = reduce(lambda a, x: a | x, [F.contains(text, F.lit(m)) for m in marks], F.lit(False)) if marks else F.lit(True)
    return F.when(worth & text.rlike(pattern), all_of).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """Spans by (kind as listed, start) if by_kind, else by (start, kind as listed)."""
    ranked = F.transform(
        spans,
        lambda s: F.struct(*([F.array_position(F.array(*map(F.lit, kinds)), s["kind"]), s["start"]] if by_kind else [s["start"], F.array_position(F.array(*map(F.lit, kinds)), s["kind"])]), s.alias("span")),
    )
    return F.transform(F.array_sort(ranked), lambda r: r["span"])


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


#: Code points of the parts that replaced() cuts texts into.
_PART = 1024


def replaced(text: Column, spans: Column) -> Column:
    """text with each span (in order of start) replaced by its kind in angle brackets; a span that
    begins inside the one before only lengthens it."""

    def between(parts: Column, start: Column, end: Column) -> Column:
        """The text from start to end, of its parts: no place is counted from the start of the text."""
        first, last = F.floor(start / _PART).cast("int"), F.floor(end / _PART).cast("int")
        head, tail = (F.coalesce(F.get(parts, k), F.lit("")) for k in (first, last))
        within = F.substring(head, start % _PART + 1, end - start)
        across = F.concat(F.substring(head, start % _PART + 1, F.lit(_PART)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), end % _PART))
        return F.when(first == last, within).otherwise(across)

    def pieces(parts: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        return let(ends, lambda ends: written(parts, ends))

    def written(parts: Column, ends: Column) -> Column:
        since = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends))
        made = F.zip_with(spans, since, lambda s, at: F.when(s["start"] >= at, F.concat(between(parts, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
        return F.concat(F.array_join(made, ""), between(parts, F.element_at(ends, -1), F.length(text)))

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)), pieces)).otherwise(text)
