"""Spans of pattern matches as column expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 128       # array elements that are summed together


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _scan(values: Column, first: Column) -> Column:
    """first, first + v1, first + v1 + v2, …"""
    return F.aggregate(values, F.array(first), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))


def running_totals(values: Column) -> Column:
    """The sum before every element of an array of longs. Blocks of STEP elements keep the copying within n·√n."""
    zero = F.lit(0).cast("long")

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int"))
        parts = F.transform(numbers, lambda b: F.slice(v, b * STEP + 1, F.lit(STEP)))
        return let(parts, lambda p: let(
            _scan(F.transform(p, lambda own: F.aggregate(own, zero, lambda s, x: s + x)), zero),
            lambda offset: F.flatten(F.transform(p, lambda own, i: F.slice(_scan(own, offset[i]), F.lit(1), F.size(own))))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.slice(F.array(zero), 1, 0)))


def matches(text: Column, pattern: str, group: int = 0, context: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value, before), in code points.

    ``value`` is the given group; ``before`` the last ``context`` characters between the match before and this one.
    The pattern must not match the empty string. Texts without a match give an empty array after one search.
    """
    long = lambda s: F.length(s).cast("long")

    def located(x: Column) -> Column:
        lengths = F.transform(x["whole"], lambda m, i: long(x["pieces"][i]) + long(m))
        return let(running_totals(lengths), lambda before: F.transform(x["whole"], lambda m, i: let(
            before[i] + long(x["pieces"][i]), lambda start: F.struct(
                start.alias("start"), (start + long(m)).alias("end"), x["value"][i].alias("value"),
                F.right(x["pieces"][i], F.lit(context)).alias("before")))))

    found = F.struct(F.split(text, pattern, -1).alias("pieces"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    return F.coalesce(F.when(text.rlike(pattern), let(found, located)).otherwise(none), F.array().cast(
        "array<struct<start:bigint,end:bigint,value:string,before:string>>"))


def labelled(found: Column, order: int, kind: str) -> Column:
    """(start, order, kind, end) of spans: sorting puts them by start, then by the order of kinds."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"),
                                                 F.lit(kind).alias("kind"), m["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


__all__ = ["let", "matches", "running_totals", "labelled", "joined"]
