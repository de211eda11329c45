"""The row-wise operators on Structured Streaming frames.

``histogram``, ``convolve``, ``clip`` and ``join_between`` against a static table keep no
state, so they apply to a stream unchanged. ``windowed_vertical`` adds the
position-wise aggregates per event-time window, late rows bounded by a watermark.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vertical
from vecloom.operators.vertical import fixed_columns

_OPS = {"sum": vertical.sum, "mean": vertical.mean, "avg": vertical.mean, "min": vertical.min, "max": vertical.max}


def windowed_vertical(stream: DataFrame, time: str, window: str, watermark: str, aggs: dict[str, tuple[str, str]], by=(), length: int | None = None) -> DataFrame:
    """Per window and key, the lists of ``out: (column, op)`` until the watermark passes.

    With ``length``, the lists' known length up to 200, state holds one number
    a position; without it, state holds a window's lists, for windows of few rows.
    """
    by = [by] if isinstance(by, str) else list(by)
    groups = stream.withWatermark(time, watermark).groupBy(F.window(time, window).alias("window"), *by)
    if length is None:
        return groups.agg(*[_OPS[op](c).alias(out) for out, (c, op) in aggs.items()])
    parts, pick = fixed_columns(stream, aggs, length)
    return groups.agg(*parts).select("window", *by, *pick)
