"""Peri-stimulus time histogram: clip to trials, bin from the onset, average by unit."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import histogram
from vecloom.operators import join_between


def psth(units: DataFrame, trials: DataFrame, unit: str, values: str, bounds, start: float, stop: float, spacing: float) -> DataFrame:
    """Mean count by unit and bin: columns unit, pos, mean_count."""
    n = math.ceil((stop - start) / spacing)
    clipped = join_between(units, trials, values, bounds, relative=True)
    counts = histogram(values, start=start, stop=stop, spacing=spacing)
    # a row per bin, combined before the shuffle, whatever the number of bins
    bins = clipped.select(unit, F.posexplode(F.coalesce(counts, F.array_repeat(F.lit(None).cast("bigint"), n))).alias("pos", "n"))
    return bins.groupBy(unit, "pos").agg(F.avg("n").alias("mean_count"))
