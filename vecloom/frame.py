from pyspark.sql import DataFrame

from vecloom.functions import clip, convolve, histogram, vertical
from vecloom.operators import diff_rows, join_between, vertical_agg


class Vec:
    """The operators as methods: ``Vec(df).join_between(...)``; row-wise ones replace their column, or add ``out``."""

    def __init__(self, df: DataFrame):
        self.df = df

    def join_between(self, other, values, bounds, **options) -> DataFrame:
        other = other.df if isinstance(other, Vec) else other
        return join_between(self.df, other, values, bounds, **options)

    def agg(self, by, aggs, length=None) -> DataFrame:
        return vertical_agg(self.df, by, aggs, length)

    def diff(self, columns, order_by, partition_by=()) -> DataFrame:
        return diff_rows(self.df, columns, order_by, partition_by)

    def _put(self, column, value, out) -> DataFrame:
        return self.df.withColumn(out or column, value)

    def histogram(self, column: str, bins=None, *, out: str | None = None, **options) -> DataFrame:
        return self._put(column, histogram(column, bins, **options), out)

    hist = histogram

    def convolve(self, column: str, kernel, fill_value: float = 0.0, mode: str = "same", *, out: str | None = None) -> DataFrame:
        return self._put(column, convolve(column, kernel, fill_value, mode), out)

    def clip(self, column: str, start, stop, *, out: str | None = None, **options) -> DataFrame:
        return self._put(column, clip(column, start, stop, **options), out)

    def _vertical(self, op, columns, by) -> DataFrame:
        return vertical_agg(self.df, by, {c: (c, op) for c in columns})

    def sum(self, *columns: str, by=()) -> DataFrame:
        return self._vertical("sum", columns, by)

    def mean(self, *columns: str, by=()) -> DataFrame:
        return self._vertical("mean", columns, by)

    avg = mean

    def min(self, *columns: str, by=()) -> DataFrame:
        return self._vertical("min", columns, by)

    def max(self, *columns: str, by=()) -> DataFrame:
        return self._vertical("max", columns, by)

    def running(self, op: str, column: str, window, *, out: str | None = None) -> DataFrame:
        """A position-wise sum, mean, min or max over a window."""
        return self._put(column, getattr(vertical, op)(column, window=window), out)
