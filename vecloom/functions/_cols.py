from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """A Column from a name or a Column."""
    if isinstance(c, str):
        return F.col(c)
    if isinstance(c, Column):
        return c
    raise TypeError(f"expected a column name or Column, got {type(c).__name__}")


def as_bound(b) -> Column:
    """A Column from a name, a Column or a number."""
    return as_col(b) if isinstance(b, (str, Column)) else F.lit(b)


def many(cols, one):
    """Apply ``one`` to each input: one input gives a Column, several a list of them."""
    flat = [x for c in cols for x in (c if isinstance(c, (list, tuple)) else [c])]
    if not flat:
        raise ValueError("at least one column is needed")
    out = [one(as_col(c)) for c in flat]
    return out[0] if len(out) == 1 else out


def is_finite(x: Column) -> Column:
    d = x.cast("double")
    return x.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once; in a lambda's body it would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
