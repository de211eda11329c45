"""Column expressions over array columns; names shadow builtins on purpose."""

from vecloom.functions.clip import clip
from vecloom.functions.convolve import convolve
from vecloom.functions.histogram import hist, histogram
from vecloom.functions.vertical import avg, diff, max, mean, min, sum  # noqa: A004

__all__ = ["avg", "clip", "convolve", "diff", "hist", "histogram", "max", "mean", "min", "sum"]
