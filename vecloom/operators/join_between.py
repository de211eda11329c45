from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions._cols import as_bound, as_col, let
from vecloom.functions.clip import clipped, is_sorted, known_values


#: Rows of ``other`` that meet a list at once where there are no keys: for counts, and for values, which they copy.
CHUNK_COUNTS, CHUNK_VALUES = 256, 16


def _keys(x, side):
    items = list(x) if isinstance(x, (list, tuple)) else [x]
    if not all(isinstance(i, (str, Column)) for i in items):
        raise TypeError(f"{side} must be column names or Columns")
    return items


def join_between(
    df: DataFrame, other: DataFrame, values, bounds, *, on=None, left_on=None, right_on=None, relative: bool = False,
    as_counts: bool = False, check_sortedness: bool = True, name: str | None = None, allow_parallel: bool = True, force_parallel: bool = False,
) -> DataFrame:
    """Each row of ``df`` with each row of ``other`` (or those equal in the keys), its list clipped to [start, stop).

    ``bounds``: (start, stop), each a name, a Column over ``other`` or a
    literal. ``relative`` subtracts start, ``as_counts`` gives the number of
    values. No hit: empty list. Null list or bound: null. Null elements are
    dropped. start above stop: empty list. Unsorted lists raise unless
    ``check_sortedness`` is off, where they are filtered. Null keys match nothing.

    Bounds are evaluated on ``other`` and the sort check on ``df``, once a row,
    before the join; a pair then costs two binary searches and its hits.
    Without keys the output has a row per pair by definition: ``other`` is
    counted first and its rows are packed, some to a row, as each row of the
    join copies a whole list; Spark broadcasts a side only if it is below its
    broadcast threshold. Columns: df's but for
    the values, the values, other's. Clashing names: with keys ``_right`` is
    added, else an error. ``name`` names an expression's output. The parallel
    flags are accepted for compatibility; Spark decides.
    """
    if not isinstance(bounds, (list, tuple)) or len(bounds) != 2:
        raise ValueError("bounds must be (start, stop)")
    if on is not None and (left_on is not None or right_on is not None):
        raise ValueError("Cannot specify both on and left_on/right_on")
    if (left_on is None) != (right_on is None):
        raise ValueError("left_on and right_on go together")
    lk, rk = (_keys(on, "on"),) * 2 if on is not None else (_keys(left_on, "left_on"), _keys(right_on, "right_on")) if left_on is not None else ([], [])
    if len(lk) != len(rk):
        raise ValueError("left_on and right_on need the same number of keys")
    if name is None:
        name = values if isinstance(values, str) else df.select(values).columns[0]
    keyed = bool(lk)
    dropped = {k for k in rk if isinstance(k, str)} if keyed else set()
    left_out = [c for c in df.columns if c != name]
    right_out = [c for c in other.columns if c not in dropped]
    taken = {*left_out, name}
    clash = [c for c in right_out if c in taken]
    if clash and not keyed:
        raise ValueError(f"columns on both sides: {clash}")
    renamed = {c: f"{c}_right" if c in clash else c for c in right_out}

    def checked(v):
        ordered = is_sorted(v)
        if check_sortedness:
            ordered = ordered | F.raise_error(F.lit("values must be sorted in ascending order")).cast("boolean")
        return F.struct(v.alias("v"), ordered.alias("s"))

    # inside a lambda, as generated code would put off the check to each pair
    given = let(known_values(as_col(values)), checked)
    left = df.select(*[F.col(f"`{c}`").alias(f"__l_{i}") for i, c in enumerate(left_out)], given.alias("__p"), *[as_col(k).alias(f"__lk{i}") for i, k in enumerate(lk)])
    right = other.select(*[F.col(f"`{c}`").alias(f"__r_{i}") for i, c in enumerate(right_out)], as_bound(bounds[0]).alias("__a"), as_bound(bounds[1]).alias("__b"), *[as_col(k).alias(f"__rk{i}") for i, k in enumerate(rk)])
    clip = lambda a, b: clipped(F.col("__p.v"), a, b, F.col("__p.s"), relative and not as_counts, as_counts)
    names = [f"__r_{i}" for i in range(len(right_out))]
    if keyed:
        joined = left.join(right, [F.col(f"__lk{i}") == F.col(f"__rk{i}") for i in range(len(lk))], "inner").withColumn("__out", clip(F.col("__a"), F.col("__b")))
    elif right.isStreaming or not all(isinstance(f.dataType, T.AtomicType) for f in right.schema):
        joined = left.crossJoin(right).withColumn("__out", clip(F.col("__a"), F.col("__b")))
    else:
        packed = _packed(right, CHUNK_COUNTS if as_counts else CHUNK_VALUES)
        each = F.transform("__rows", lambda r: F.array_repeat(F.struct(*[r[c].alias(c) for c in names], clip(r["__a"], r["__b"]).alias("__out")), r["__n"]))
        joined = left.crossJoin(packed).select(*[f"__l_{i}" for i in range(len(left_out))], F.inline(F.flatten(each)))
    return joined.select(*[F.col(f"__l_{i}").alias(c) for i, c in enumerate(left_out)], F.col("__out").alias(name), *[F.col(f"__r_{i}").alias(renamed[c]) for i, c in enumerate(right_out)])


def _packed(right: DataFrame, each: int) -> DataFrame:
    """About ``each`` different rows to a row (__rows), with how often each is there, so that a list is copied once for all of them."""
    n = max(1, -(-right.count() // each))
    once = right.groupBy(*right.columns).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    return once.groupBy(F.pmod(F.xxhash64(*right.columns), F.lit(n))).agg(F.collect_list(F.struct(*right.columns, "__n")).alias("__rows")).select("__rows")
