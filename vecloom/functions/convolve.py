import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions._cols import as_col, let

#: mode -> (output length, offset) for signal length m and kernel length n
_MODES = {
    "full": (lambda m, n: m + (n - 1), lambda n: 0),
    "same": (lambda m, n: F.greatest(m, F.lit(n)), lambda n: (n - 1) // 2),
    "valid": (lambda m, n: F.abs(m - n) + 1, lambda n: n - 1),
    "left": (lambda m, n: m, lambda n: 0),
    "right": (lambda m, n: m, lambda n: n - 1),
}


def convolve(expr, kernel, fill_value: float = 0.0, mode: str = "same") -> Column:
    """1-D convolution of each row's list with a literal kernel, as doubles.

    Null row: null. Null element: ``fill_value``. Empty list: empty. Entries of
    the kernel that are not finite are dropped. ``same`` is as long as the
    longer of signal and kernel; ``left`` and ``right`` as long as the signal.
    The kernel loop is unrolled, so each output element is one flat sum.
    """
    if isinstance(kernel, Column):
        raise TypeError("kernel must be a list of numbers, not a column")
    k = [float(x) for x in kernel if x is not None and math.isfinite(float(x))]
    if not k:
        raise ValueError("Kernel cannot be empty")
    if mode not in _MODES:
        raise ValueError(f"Invalid mode {mode!r}; one of {', '.join(_MODES)}")
    c, n = as_col(expr), len(k)
    signal = F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(float(fill_value))))
    length, offset = _MODES[mode][0](F.size(c), n), _MODES[mode][1](n)

    def at(signal, i):
        # ascending signal position, so the same order of additions everywhere
        total = F.lit(0.0)
        for j in range(n - 1, -1, -1):
            p = i + F.lit(offset - j)
            total = total + F.when(p >= 0, F.coalesce(F.get(signal, p), F.lit(0.0))).otherwise(F.lit(0.0)) * F.lit(k[j])
        return total

    out = let(signal, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: at(s, i)))
    return F.when(c.isNull(), None).when(F.size(c) == 0, F.array().cast("array<double>")).otherwise(out)
