"""vecloom: vertical and per-row analytics over numeric array columns, on Spark.

``functions`` holds Column expressions, ``operators`` DataFrame operators,
``plans`` composed queries, ``sources`` table access, ``streaming`` the forms
usable on streams.
"""

from vecloom.frame import Vec
from vecloom.functions import avg, clip, convolve, diff, hist, histogram, max, mean, min, sum  # noqa: A004
from vecloom.operators import diff_rows, join_between, vertical_agg

__version__ = "0.1.0"
__all__ = ["Vec", "avg", "clip", "convolve", "diff", "diff_rows", "hist", "histogram", "join_between", "max", "mean", "min", "sum", "vertical_agg", "__version__"]
