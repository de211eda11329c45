"""Position-wise aggregates as Columns, usable in ``agg``, ``select`` and ``over``.

They gather a group's lists with ``collect_list``, so a group must fit in one
task; ``operators.vertical_agg`` is the form for large groups. Null rows are
skipped; lists of different lengths in a group are an error; a group of null
rows gives one null. Empty lists give an empty list.
"""

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from vecloom.functions._cols import many


def _fold(c: Column, name: str, init, merge, finish, window: WindowSpec | None) -> Column:
    lists = F.collect_list(c)
    if window is not None:
        lists = lists.over(window)

    def step(acc, x):
        bad = F.raise_error(F.concat(F.lit(f"All lists must have the same length for vertical {name}. Expected "), F.size(acc).cast("string"), F.lit(", got "), F.size(x).cast("string")))
        return F.when(F.size(acc) == F.size(x), merge(acc, x)).otherwise(bad)

    folded = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), init(F.get(lists, F.lit(0))), step)
    return F.when(F.size(lists) > 0, finish(folded))


def _skip(f):
    return lambda acc, x: F.zip_with(acc, x, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b)))


def sum(*exprs, window: WindowSpec | None = None):  # noqa: A001
    """Position-wise sum; null elements count as 0, also where every row is null."""
    same = lambda x: x
    return many(exprs, lambda c: _fold(c, "sum", same, _skip(lambda a, b: a + b), lambda r: F.transform(r, lambda e: F.coalesce(e, F.lit(0).cast("tinyint"))), window))


def mean(*exprs, window: WindowSpec | None = None):
    """Position-wise mean as doubles; null elements are left out; a position null in every row gives NaN."""
    init = lambda l: F.transform(l, lambda e: F.struct(F.coalesce(e.cast("double"), F.lit(0.0)).alias("s"), F.when(e.isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("n")))  # noqa: E731, E741
    merge = lambda acc, x: F.zip_with(acc, x, lambda a, e: F.struct((a["s"] + F.coalesce(e.cast("double"), F.lit(0.0))).alias("s"), (a["n"] + F.when(e.isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint")).alias("n")))
    finish = lambda r: F.transform(r, lambda a: F.when(a["n"] == 0, F.lit(float("nan"))).otherwise(a["s"] / a["n"]))
    return many(exprs, lambda c: _fold(c, "mean", init, merge, finish, window))


avg = mean


def min(*exprs, window: WindowSpec | None = None):  # noqa: A001
    """Position-wise minimum; nulls are skipped, NaN is the largest value."""
    return many(exprs, lambda c: _fold(c, "min", lambda l: l, _skip(F.least), lambda r: r, window))  # noqa: E741


def max(*exprs, window: WindowSpec | None = None):  # noqa: A001
    """Position-wise maximum; nulls are skipped, NaN is the largest value."""
    return many(exprs, lambda c: _fold(c, "max", lambda l: l, _skip(F.greatest), lambda r: r, window))  # noqa: E741


def diff(*exprs, window: WindowSpec):
    """Each list minus the one before it in ``window`` (partition and order).

    The first row, and a row next to a null row, gives a list of nulls as long
    as the first non-null list; in a partition of null rows they stay null.
    """

    def one(c: Column) -> Column:
        prev = F.lag(c).over(window)
        whole = window.rowsBetween(-(1 << 63), (1 << 63) - 1)
        length = F.first(F.size(c), ignorenulls=True).over(whole)
        bad = F.raise_error(F.concat(F.lit("All lists must have the same length for vertical diff. Expected "), length.cast("string")))
        blank = F.transform(F.first(c, ignorenulls=True).over(whole), lambda e: F.when(F.lit(False), e))
        return F.when(c.isNotNull() & prev.isNotNull(), F.when(F.size(c) == F.size(prev), F.zip_with(c, prev, lambda a, b: a - b)).otherwise(bad)).otherwise(blank)

    return many(exprs, one)
