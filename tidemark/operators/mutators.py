"""Array edits as column expressions, and the positions an edit touches: what a change log of an array is replayed with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(a: Column) -> Column:
    return F.size(a)


def _part(a: Column, begin: Column, count: Column) -> Column:
    """`count` items from position `begin`; a count below 1 gives none."""
    return F.when(count > 0, F.slice(a, (begin + 1).cast("int"), F.greatest(count, F.lit(1)).cast("int"))).otherwise(F.slice(a, 1, 0))


def put(a: Column, at: Column, value: Column) -> Column:
    """Set one position."""
    return F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))


def push(a: Column, *values: Column) -> Column:
    return F.concat(a, F.array(*values))


def pop(a: Column) -> Column:
    return _part(a, F.lit(0), _n(a) - 1)


def shift(a: Column) -> Column:
    return _part(a, F.lit(1), _n(a) - 1)


def unshift(a: Column, *values: Column) -> Column:
    return F.concat(F.array(*values), a)


def splice(a: Column, at: Column, remove: Column, *values: Column) -> Column:
    """Remove items from a position on and put others there; positions and counts are clamped to the array."""
    at = F.least(F.greatest(at, F.lit(0)), _n(a))
    remove = F.least(F.greatest(remove, F.lit(0)), _n(a) - at)
    middle = [F.array(*values)] if values else []
    return F.concat(_part(a, F.lit(0), at), *middle, _part(a, at + remove, _n(a) - at - remove))


def set_length(a: Column, n: Column) -> Column:
    return _part(a, F.lit(0), F.least(n, _n(a)))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def sort(a: Column) -> Column:
    return F.array_sort(a)


def fill(a: Column, value: Column, begin: Column, end: Column) -> Column:
    return F.transform(a, lambda x, i: F.when((i >= begin) & (i < end), value).otherwise(x))


def copy_within(a: Column, to: Column, begin: Column, end: Column) -> Column:
    """Copy items [begin, end) over those from `to` on, within the length."""
    return F.transform(a, lambda x, i: F.when((i >= to) & (i < to + (F.least(end, _n(a)) - begin)), F.get(a, (i - to + begin).cast("int"))).otherwise(x))


def touched(before: Column, after: Column) -> Column:
    """Positions whose item an edit changed or added, in order; those it cut off aren't listed."""
    changed = F.transform(after, lambda x, i: F.when((i >= _n(before)) | ~F.get(before, i).eqNullSafe(x), i))
    return F.filter(changed, lambda i: i.isNotNull())
