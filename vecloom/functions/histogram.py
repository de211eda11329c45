"""Per-row histograms.

``bins`` is an int (equal bins over the row's finite range), a column of such
ints, or a list of edges; ``start, stop, spacing`` give a fixed range, each a
number, a column name or a Column. Bins are half-open but for the last, which
is closed. Values that are null, NaN, infinite or outside are dropped.

Literal bins and ranges are counted by one vectorised pass over an Arrow batch
(``engine='arrow'``), as interpreted higher-order functions cost bins x values;
``engine='expr'`` stays in the JVM. Edges and per-row parameters use 'expr'.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions._cols import as_col, is_finite, let

_TYPES = {None: "bigint", "u32": "bigint", "int": "bigint", int: "bigint", "u16": "int", "u8": "smallint", "bool": "boolean", bool: "boolean"}
_MOST = {"u8": 255, "u16": 65535}


def _count_dtype(t):
    if t not in _TYPES:
        raise TypeError(f"count_dtype must be one of bool, u8, u16, u32, int; got {t!r}")
    return t


def _cast(counts: Column, t) -> Column:
    if _TYPES[t] == "boolean":
        return F.transform(counts, lambda n: n > 0)
    if t in _MOST:
        return F.transform(counts, lambda n: F.when(n > _MOST[t], F.raise_error(F.lit(f"a count does not fit {t}"))).otherwise(n).cast(_TYPES[t]))
    return counts


def _uniform(v: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Counts in n bins by index arithmetic; v holds finite values from lo to hi, lo < hi."""

    def count(idx, n):
        return F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda b: F.size(F.filter(idx, lambda i: i == b)).cast("bigint"))

    def index(s):
        idx = F.transform(s["v"], lambda x: F.least(F.floor((x.cast("double") - s["lo"]) * s["inv"]), s["n"] - 1))
        return let(F.struct(idx.alias("idx"), s["n"].alias("n")), lambda t: count(t["idx"], t["n"]))

    return let(F.struct(v.alias("v"), lo.alias("lo"), (n.cast("double") / (hi - lo)).alias("inv"), n.cast("bigint").alias("n")), index)


def _span(arr: pa.Array):
    """Per row starts and lengths, and the flat values as doubles with NaN for null."""
    off = np.asarray(arr.offsets, dtype=np.int64)
    base = int(off[0]) if len(off) else 0
    flat = arr.values.slice(base, (int(off[-1]) - base) if len(off) else 0).cast(pa.float64())
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.null_count:
        v = np.where(np.asarray(flat.is_null()), np.nan, v)
    return off - base, v


def _lists(counts: np.ndarray, null: np.ndarray) -> pa.Array:
    rows, n = counts.shape
    off = pa.array(np.arange(rows + 1, dtype=np.int32) * n, mask=np.append(null, False)) if null.any() else pa.array(np.arange(rows + 1, dtype=np.int32) * n)
    return pa.ListArray.from_arrays(off, pa.array(counts.ravel()))


#: Values that are counted at a time, so that what is held beside them stays in the processor's cache.
_AT_ONCE = 1 << 15


def _stretches(off):
    """(first row, end row) of stretches of about _AT_ONCE values."""
    at, rows = 0, len(off) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + _AT_ONCE, side="right")) - 1)
        yield at, min(to, rows)
        at = to


def _add(counts, idx, n):
    """Counts of each row's indexes, rows x values, in n bins; idx is used up."""
    np.minimum(idx, n - 1, out=idx)
    idx += (np.arange(len(idx)) * n)[:, None]
    counts += np.bincount(idx.ravel(), minlength=counts.size).reshape(counts.shape)


def _counted(arr: pa.Array, n: int, bounds) -> pa.Array:
    """Per row the counts of the values from lo to hi in n bins; ``bounds(least, largest)`` gives lo and hi, or None where they don't depend on rows."""
    rows = len(arr)
    null = np.asarray(arr.is_null()) if rows else np.zeros(0, bool)
    off, v = _span(arr)
    counts = np.zeros((rows, n), np.int64)
    for a, b in _stretches(off):
        x, own = v[off[a] : off[b]], np.diff(off[a : b + 1])
        whole = len(x) and (own == own[0]).all()
        if whole:  # rows of one length, mostly without gaps
            x = x.reshape(b - a, -1)
            least, most = x.min(1), x.max(1)
            lo, hi = bounds(least, most)
            if np.isfinite(least).all() and np.isfinite(most).all() and (lo <= least).all() and (most <= hi).all():
                t = x - lo[:, None]
                t *= (n / (hi - lo))[:, None]
                _add(counts[a:b], t.astype(np.int64), n)
                continue
            x = x.ravel()
        ok = np.isfinite(x)
        full, begin = np.flatnonzero(own > 0), (off[a:b] - off[a])[own > 0]
        least, most = np.full(b - a, np.inf), np.full(b - a, -np.inf)
        if len(full):
            least[full], most[full] = np.minimum.reduceat(np.where(ok, x, np.inf), begin), np.maximum.reduceat(np.where(ok, x, -np.inf), begin)
        lo, hi = bounds(least, most)
        row = np.repeat(np.arange(b - a), own)
        with np.errstate(invalid="ignore"):
            ok &= (x >= lo[row]) & (x <= hi[row])
            x, row = x[ok], row[ok]
            idx = np.minimum(((x - lo[row]) * (n / (hi - lo))[row]).astype(np.int64), n - 1)
        counts[a:b] += np.bincount(row * n + idx, minlength=(b - a) * n).reshape(b - a, n)
    return _lists(counts, null)


def _arrow_bins(n: int):
    def spread(least, most):
        flat = least == most
        return np.where(flat, least - 0.5, least), np.where(flat, most + 0.5, most)

    @F.arrow_udf("array<bigint>")
    def count(arr: pa.Array) -> pa.Array:
        return _counted(arr, n, spread)

    return count


def _arrow_range(start: float, stop: float, n: int):
    def fixed(least, most):
        return np.full(len(least), start), np.full(len(least), stop)

    @F.arrow_udf("array<bigint>")
    def count(arr: pa.Array) -> pa.Array:
        return _counted(arr, n, fixed)

    return count


def histogram(expr, bins=None, *, start=None, stop=None, spacing=None, count_dtype=None, include_breakpoints: bool = False, engine: str = "arrow") -> Column:
    """Histogram of each row's list: a list of counts, or struct(breakpoints, counts).

    With ``bins=n``: a row without finite values gives n zeros (with
    breakpoints or per-row bins: null); a constant row spans half a unit to
    each side (with breakpoints or per-row bins: one bin). A null row is null;
    with breakpoints it is a struct of nulls. A range counts by uniform bins,
    even where the last is narrower.
    """
    if isinstance(bins, bool):
        raise TypeError("bins must be an int, a list of edges or a column, not a bool")
    ranged = {"start": start, "stop": stop, "spacing": spacing}
    given = [k for k, v in ranged.items() if v is not None]
    if bins is not None and given:
        raise ValueError("Cannot specify both bins and start/stop/spacing")
    if bins is None and not given:
        raise ValueError("Must specify either bins or start, stop and spacing")
    if bins is None and len(given) < 3:
        raise ValueError(f"All of start, stop, spacing are required. Missing: {[k for k in ranged if k not in given]}")
    if engine not in ("arrow", "expr"):
        raise ValueError("engine must be 'arrow' or 'expr'")
    t, c = _count_dtype(count_dtype), as_col(expr)
    finite = F.filter(c, is_finite)

    if isinstance(bins, int):
        if bins <= 0:
            raise ValueError(f"bins must be positive, got {bins}")
        if not include_breakpoints and engine == "arrow":
            return _cast(_arrow_bins(bins)(c), t)
        return _by_count(c, finite, F.lit(bins), t, include_breakpoints, general=include_breakpoints)
    if isinstance(bins, (str, Column)):
        n = as_col(bins)
        n = F.when(n <= 0, F.raise_error(F.concat(F.lit("bins must be positive, got "), n.cast("string")))).otherwise(n)
        return _by_count(c, finite, n, t, include_breakpoints, general=True)
    if isinstance(bins, list):
        edges = sorted(float(x) for x in bins)
        if len(edges) < 2:
            raise ValueError("at least 2 bin edges are needed")
        if not all(map(math.isfinite, edges)):
            raise ValueError("bin edges must be finite")
        e = F.array(*[F.lit(x) for x in edges])
        # a value belongs to the bin after the last edge not above it; the last edge itself to the last bin
        inside = F.filter(finite, lambda x: (x.cast("double") >= edges[0]) & (x.cast("double") <= edges[-1]))
        idx = F.transform(inside, lambda x: F.when(x.cast("double") == edges[-1], F.lit(len(edges) - 2)).otherwise(F.size(F.filter(e, lambda y: y <= x.cast("double"))) - 1))
        counts = let(idx, lambda own: F.transform(F.sequence(F.lit(0), F.lit(len(edges) - 2)), lambda b: F.size(F.filter(own, lambda i: i == b)).cast("bigint")))
        return _out(c.isNotNull(), e, counts, t, include_breakpoints)
    if bins is not None:
        raise TypeError(f"bins must be an int, a list of edges or a column, got {type(bins).__name__}")

    literal = all(not isinstance(x, (str, Column)) for x in ranged.values())
    if literal:
        a, b, s = (float(x) for x in ranged.values())
        if not s > 0:
            raise ValueError(f"spacing must be positive, got {s}")
        if not a < b:
            raise ValueError(f"start must be less than stop, got {a} and {b}")
        if engine == "arrow" and not include_breakpoints:
            return _cast(_arrow_range(a, b, math.ceil((b - a) / s))(c), t)
    a, b, s = ((as_col(x) if isinstance(x, (str, Column)) else F.lit(float(x))).cast("double") for x in ranged.values())
    known = c.isNotNull() & a.isNotNull() & b.isNotNull() & s.isNotNull()
    n = F.when(s <= 0, F.raise_error(F.lit("spacing must be positive"))).when(a >= b, F.raise_error(F.lit("start must be less than stop"))).otherwise(F.ceil((b - a) / s))
    edges = F.concat(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: a + i * s), F.array(b))
    inside = F.filter(finite, lambda x: (x.cast("double") >= a) & (x.cast("double") <= b))
    return _out(known, edges, _uniform(inside, a, b, n), t, include_breakpoints)


def _out(known: Column, edges: Column, counts: Column, t, breakpoints: bool) -> Column:
    counts = F.when(known, _cast(counts, t))
    return F.struct(F.when(known, edges).alias("breakpoints"), counts.alias("counts")) if breakpoints else counts


def _by_count(c, finite, n, t, breakpoints, general):
    lo0, hi0 = F.array_min(finite).cast("double"), F.array_max(finite).cast("double")
    flat, none = lo0 == hi0, F.size(finite) == 0
    lo, hi = F.when(flat, lo0 - 0.5).otherwise(lo0), F.when(flat, hi0 + 0.5).otherwise(hi0)
    m = F.when(flat, F.lit(1)).otherwise(n) if general else n
    edges = F.concat(F.transform(F.sequence(F.lit(0), m.cast("int") - 1), lambda i: lo + i * (hi - lo) / m), F.array(hi))
    counts = _uniform(finite, lo, hi, m)
    known = c.isNotNull() & n.isNotNull()
    if general:
        known = known & ~none
    else:
        counts = F.when(none, F.array_repeat(F.lit(0).cast("bigint"), n.cast("int"))).otherwise(counts)
    return _out(known, edges, counts, t, breakpoints)


hist = histogram
