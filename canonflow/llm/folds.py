"""Array functions that take time in proportion to an array's length.

A fold that appends to an array copies it each time.  These work in blocks, so
that only blocks and the list of blocks are copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once, however often body speaks of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks_of(values: Column) -> Column:
    """Consecutive slices of an array; none of an empty one."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(values, at, F.lit(BLOCK)))


def running(values: Column, step: Callable[[Column, Column], Column], zero: int) -> Column:
    """The results of step (associative, of integers, with the neutral value `zero`) over each value and all before it."""
    ints = "array<int>"

    def over(array: Column, start: Column) -> Column:
        """start, and what follows from it."""
        return F.aggregate(array, F.array(start).cast(ints), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))).cast(ints))

    def joined(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), lambda acc, x: step(acc, x)))
        return let(over(whole, F.lit(zero)), lambda starts: F.flatten(F.transform(blocks, lambda b, i: F.slice(over(b, F.get(starts, i)), 2, BLOCK))))

    return let(values, lambda v: let(blocks_of(v), joined))


def overlapping(a: Column, b: Column, wanted: bool = True) -> Column:
    """The spans of a (structs with start and end) that overlap a span of b, or those that don't; in the order of their ends.

    A sorted merge: a span x overlaps one of b if, among those of b that start before x ends, the last to end does so after x
    starts.
    """
    low = -(1 << 31)

    def both(own: Column) -> Column:
        ours = F.transform(own, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("side"), x["start"].alias("edge"), x.alias("span")))
        theirs = F.transform(b, lambda y: F.struct(y["start"].alias("at"), F.lit(1).alias("side"), y["end"].alias("edge"), F.get(own, F.lit(-1)).alias("span")))
        return F.sort_array(F.concat(ours, theirs))

    def swept(events: Column) -> Column:
        ends = running(F.transform(events, lambda e: F.when(e["side"] == 1, e["edge"]).otherwise(low)), F.greatest, low)
        told = let(ends, lambda x: F.transform(events, lambda e, i: F.struct(e["span"].alias("span"), (e["side"] == 0).alias("own"), (F.get(x, i) > e["edge"]).alias("met"))))
        return F.transform(F.filter(told, lambda e: e["own"] & (e["met"] if wanted else ~e["met"])), lambda e: e["span"])

    return let(let(a, both), swept)


def merged(spans: Column, reach: int = 0) -> Column:
    """Disjoint intervals (start, end) that cover spans sorted by start, each widened by `reach` at both ends; those that touch are one."""

    def cut(s: Column, ends: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] - 2 * reach > F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
        last = lambda firsts, k: F.coalesce(F.get(firsts, k + 1), F.size(s)) - 1
        return let(begins, lambda firsts: F.transform(firsts, lambda at, k: F.struct((F.get(s, at)["start"] - reach).alias("start"), (F.get(ends, last(firsts, k)) + reach).alias("end"))))

    return let(spans, lambda s: let(running(F.transform(s, lambda x: x["end"]), F.greatest, -(1 << 31)), lambda ends: cut(s, ends)))
