"""Vertical aggregates for large groups.

``explode``: one row per (group, position) for all columns at once, aggregated
with map-side combine in generated code, then put together again. A group's
lists are never gathered.
``fixed``: for lists of a known length, one aggregate per position and one
shuffle. Both skip null rows and check lengths.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_OPS = {
    "sum": lambda v, t: F.coalesce(F.sum(v), F.lit(0)).cast(t),
    "mean": lambda v, t: F.coalesce(F.avg(v.cast("double")), F.lit(float("nan"))),
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "count": lambda v, t: F.count(v),
    "std": lambda v, t: F.stddev_samp(v.cast("double")),
    "var": lambda v, t: F.var_samp(v.cast("double")),
    "median": lambda v, t: F.percentile(v.cast("double"), 0.5),
    "prod": lambda v, t: F.product(v.cast("double")),
}
_OPS["avg"] = _OPS["mean"]
FIXED_MOST = 200


def element_type(df: DataFrame, column: str) -> T.DataType:
    """The numeric element type of an array column, or TypeError."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, _NUMERIC):
        raise TypeError(f"Expected an array of numbers in {column}, got {kind.simpleString()}")
    return kind.elementType


def _same(n: Column, least: Column, op: str) -> Column:
    return F.when(n == least, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"All lists must have the same length for vertical {op}. Expected "), least.cast("string"), F.lit(", got "), n.cast("string"))).cast("boolean"))


def vertical_agg(df: DataFrame, by, aggs: dict[str, tuple[str, str]], length: int | None = None) -> DataFrame:
    """One row per group of ``by`` with a list per entry ``out: (column, op)`` of ``aggs``.

    op: sum, mean (avg), min, max, and also count, std, var, median, prod.
    Null elements: 0 for sum, left out otherwise (a position null throughout:
    0, NaN, null, null). A group of null rows gives null; of empty lists, an
    empty list; no rows, no row. ``length``: the lists' known length, up to
    200, for the one-shuffle plan. Null keys form a group.
    """
    by = [by] if isinstance(by, str) else list(by)
    for out, (column, op) in aggs.items():
        if op not in _OPS:
            raise ValueError(f"unknown op {op!r} for {out}")
        element_type(df, column)
    if not aggs:
        raise ValueError("no aggregates given")
    if length is not None and 0 < length <= FIXED_MOST:
        return _fixed(df, by, aggs, length)
    keys = [f"__k{i}" for i in range(len(by))]
    cols = list(dict.fromkeys(c for c, _ in aggs.values()))
    base = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    # one outer explode for all columns: null and empty lists keep their group; shorter lists are cut off again below
    lists = F.arrays_zip(*[F.coalesce(F.col(f"c{i}"), F.array()).alias(f"c{i}") for i in range(len(cols))]) if len(cols) > 1 else F.transform("c0", lambda x: F.struct(x.alias("c0")))
    sizes = [F.when(F.col(f"c{i}").isNotNull(), F.size(f"c{i}")).alias(f"__n{i}") for i in range(len(cols))]
    pos = base.select(*keys, *sizes, F.posexplode_outer(lists).alias("__p", "__v"))
    ends = [f(f"__n{i}").alias(f"__{end}{i}") for i in range(len(cols)) for end, f in (("lo", F.min), ("hi", F.max))]
    per = pos.groupBy(*keys, "__p").agg(*ends, *[_OPS[op](F.col(f"__v.c{cols.index(c)}"), element_type(df, c)).alias(f"__o{i}") for i, (c, op) in enumerate(aggs.values())])
    item = F.when(F.col("__p").isNotNull(), F.struct("__p", *[f"__o{i}" for i in range(len(aggs))]))
    whole = [f(f"__{end}{i}").alias(f"__{end}{i}") for i in range(len(cols)) for end, f in (("lo", F.min), ("hi", F.max))]
    grouped = per.groupBy(*keys).agg(*whole, F.array_sort(F.collect_list(item)).alias("__l"))
    out = []
    for i, (name, (c, op)) in enumerate(aggs.items()):
        lo, hi = F.col(f"__lo{cols.index(c)}"), F.col(f"__hi{cols.index(c)}")
        out.append(F.when(lo.isNotNull() & _same(hi, lo, op), F.slice(F.transform("__l", _field(f"__o{i}")), F.lit(1), lo)).alias(name))
    result = grouped.select(*keys, *out)
    if not by:
        result = result.crossJoin(df.limit(1).select(F.lit(1).alias("__one"))).drop("__one")
    return result.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *aggs)


def _field(name):
    return lambda x: x[name]


def _fixed(df, by, aggs, length):
    parts, pick = fixed_columns(df, aggs, length)
    g = (df.groupBy(*by) if by else df.groupBy()).agg(*parts, F.count(F.lit(1)).alias("__rows"))
    if not by:
        g = g.where("__rows > 0")
    return g.select(*by, *pick)


def fixed_columns(df: DataFrame, aggs: dict[str, tuple[str, str]], length: int) -> tuple[list[Column], list[Column]]:
    """Aggregates, one a position, and the columns that put lists together from them."""
    if not 0 < length <= FIXED_MOST:
        raise ValueError(f"length must be from 1 to {FIXED_MOST}")
    cols = list(dict.fromkeys(c for c, _ in aggs.values()))
    parts = [f(F.when(F.col(c).isNotNull(), F.size(c))).alias(f"__{end}{i}") for i, c in enumerate(cols) for end, f in (("lo", F.min), ("hi", F.max))]
    pick = []
    for name, (c, op) in aggs.items():
        kind, lo, hi = element_type(df, c), F.col(f"__lo{cols.index(c)}"), F.col(f"__hi{cols.index(c)}")
        parts.append(F.array(*[_OPS[op](F.get(F.col(c), F.lit(i)), kind) for i in range(length)]).alias(f"__a_{name}"))
        fits = F.when(hi <= length, F.lit(True)).otherwise(F.raise_error(F.lit(f"All lists must have the same length for vertical {op}. Expected {length} at most")).cast("boolean"))
        pick.append(F.when(lo.isNotNull() & _same(hi, lo, op) & fits, F.slice(f"__a_{name}", F.lit(1), lo)).alias(name))
    return parts, pick
