"""Predicates and Boolean connectives as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_in(c: Column, values: Sequence) -> Column:
    """Membership; null is in no set."""
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)


def not_in(c: Column, values: Sequence) -> Column:
    """Its negation; null is outside every set."""
    return ~is_in(c, values)


def xor(a: Column, b: Column) -> Column:
    return a != b


def xnor(a: Column, b: Column) -> Column:
    return a == b


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def not_implies(a: Column, b: Column) -> Column:
    return a & ~b


def implied_by(a: Column, b: Column) -> Column:
    return a | ~b


def not_implied_by(a: Column, b: Column) -> Column:
    return ~a & b


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def between_wrapped(x: Column, start: Column | None, end: Column | None) -> Column:
    """Inclusive range with open ends; a start at or after the end wraps round (over midnight, say)."""
    low = F.lit(True) if start is None else x >= start
    high = F.lit(True) if end is None else x <= end
    if start is None or end is None:
        return low & high
    return F.when(start < end, low & high).otherwise(low | high)


def any_in(values: Column, container: Column) -> Column:
    """Whether two arrays share an element."""
    return F.coalesce(F.arrays_overlap(values, container), F.lit(False))


def all_equal(values: Column) -> Column:
    """Whether an array's elements are all the same; nulls are equal to each other."""
    return F.size(F.array_distinct(values)) <= 1


def all_equal_to(values: Column, x: Column) -> Column:
    return F.coalesce(F.forall(values, lambda v: v.eqNullSafe(x)), F.lit(True))


def first_not_none(*columns: Column) -> Column:
    return F.coalesce(*columns)


def find_first(values: Column, test) -> Column:
    """struct(index, value) of the first element that passes the test, nulls if none does."""
    marked = F.filter(F.transform(values, lambda v, i: F.struct(i.cast("long").alias("index"), v.alias("value"))), lambda s: test(s["value"]))
    return F.get(marked, 0)
