"""Clip of sorted lists to [start, stop) by binary search, in JVM expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions._cols import as_bound, as_col, let

#: Powers of two that lead to any place of a list that is shorter than the number on the left.
_STEPS = [(n, [1 << k for k in range(n.bit_length() - 2, -1, -1)]) for n in (1 << 7, 1 << 13, 1 << 31)]


def known_values(values: Column) -> Column:
    """The list without its null elements; itself where there are none."""
    return F.when(F.exists(values, lambda x: x.isNull()), F.filter(values, lambda x: x.isNotNull())).otherwise(values)


def is_sorted(values: Column) -> Column:
    """Whether the list, free of nulls, ascends; a null list counts as sorted. NaN is the largest value."""
    return values.eqNullSafe(F.sort_array(values))


def lower_bound(values: Column, bound: Column) -> Column:
    """How many values of an ascending list without nulls are below the bound: a halving walk, a few dozen steps at any length."""
    n = F.size(values)

    def step(at, s):
        return F.when((at + s <= n) & (F.get(values, at + s - 1) < bound), at + s).otherwise(at)

    steps = F.array(*[F.lit(s) for s in _STEPS[-1][1]])
    for most, few in reversed(_STEPS[:-1]):
        steps = F.when(n < most, F.array(*[F.lit(s) for s in few])).otherwise(steps)
    return F.aggregate(steps, F.lit(0), step)


def clipped(values: Column, start: Column, stop: Column, in_order: Column, relative: bool = False, as_counts: bool = False) -> Column:
    """The values in [start, stop), those minus start, or their number; null if the list or a bound is. Lists out of order are filtered."""
    known = values.isNotNull() & start.isNotNull() & stop.isNotNull()
    inside = lambda: F.filter(values, lambda x: (x >= start) & (x < stop))
    if as_counts:
        found = F.greatest(lower_bound(values, stop) - lower_bound(values, start), F.lit(0))
        return F.when(known & in_order, found.cast("bigint")).when(known, F.size(inside()).cast("bigint"))
    found = let(lower_bound(values, start), lambda lo: F.slice(values, lo + 1, F.greatest(lower_bound(values, stop) - lo, F.lit(0))))
    out = F.when(known & in_order, found).when(known, inside())
    return F.transform(out, lambda x: x - start) if relative else out


def clip(expr, start, stop, *, relative: bool = False, as_counts: bool = False) -> Column:
    """Each row's list clipped to its own [start, stop): bounds are column names, Columns or numbers.

    ``relative`` subtracts start, ``as_counts`` gives the number of values.
    Null list or bound: null. Null elements are dropped. No hit, or start above
    stop: empty list. Lists that don't ascend are filtered instead.
    """
    a, b = as_bound(start), as_bound(stop)
    return let(known_values(as_col(expr)), lambda v: clipped(v, a, b, is_sorted(v), relative, as_counts))
