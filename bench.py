"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the median counts.
``histogram_100k_x_1000`` is the published benchmark of 100,000 rows x 1,000
doubles in 50 bins, read from a Parquet file that the bench writes itself;
``scan_100k_x_1000`` is that scan alone, and ``_cached`` takes rows that Spark
holds in memory. ``join_between_10x500`` is 10 lists of 100,000 values by 500
intervals, in memory, as counts, values and relative values; ``psth_10x...``
clips 10 such lists to intervals of 5.5 s and bins them.
"""

import json
import os
import shutil
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecloom.functions import histogram
from vecloom.operators import join_between
from vecloom.plans.psth import psth
from vecloom.plans.queries import QUERIES

HEADLINE = ["psth_by_user", "vec_sum", "vec_sum_fixed", "vec_mean", "vec_min", "vec_max", "vec_diff", "vec_convolve_same", "vec_histogram_bins", "vec_histogram_range", "join_between_counts", "join_between_cross", "join_between_keyed"]


def timed(f, repeats=3):
    f()
    out = []
    for _ in range(repeats):
        t = time.perf_counter()
        f()
        out.append(time.perf_counter() - t)
    return median(out)


def main():
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "32m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    times = {}
    try:
        for name in HEADLINE:
            times[name] = round(timed(lambda n=name: noop(QUERIES[n](spark, sf_dir))), 4)
        if os.environ.get("BENCH_LARGE", "1") == "1":
            path = f"{scratch}/big"
            spark.range(0, 100_000, 1, 4 * int(cpus)).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1 << 40)) / F.lit((1 << 40) / 10.0)).alias("a")).write.option("compression", "uncompressed").parquet(path)
            big = spark.read.parquet(path)
            times["scan_100k_x_1000"] = round(timed(lambda: noop(big.select("a"))), 4)
            times["histogram_100k_x_1000"] = round(timed(lambda: noop(big.select(histogram("a", 50)))), 4)
            held = big.cache()
            held.count()
            times["histogram_100k_x_1000_cached"] = round(timed(lambda: noop(held.select(histogram("a", 50)))), 4)
            held.unpersist()
        if os.environ.get("BENCH_SHAPES", "1") == "1":
            units = spark.range(0, 10, 1, 10).select(F.col("id").alias("unit"), F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: i * 0.05 + F.col("id") * 0.001).alias("t")).cache()
            units.count()
            for n in (500, 1000, 2000):
                trials = spark.range(n).select(F.col("id").alias("trial"), (F.col("id") * 2.4).alias("a"), (F.col("id") * 2.4 + 5.5).alias("b")).cache()
                trials.count()
                if n == 500:
                    for kind, options in (("counts", {"as_counts": True}), ("values", {}), ("relative", {"relative": True})):
                        times[f"join_between_10x500_{kind}"] = round(timed(lambda o=options: noop(join_between(units, trials, "t", ("a", "b"), **o))), 4)
                for spacing in (0.1, 0.01):
                    times[f"psth_10x{n}_{spacing}"] = round(timed(lambda s=spacing: noop(psth(units, trials, "unit", "t", ("a", "b"), 0.0, 5.5, s))), 4)
    finally:
        spark.stop()
        shutil.rmtree(scratch, ignore_errors=True)
    value = round(sum(t for n, t in times.items() if n in HEADLINE), 4)
    print(json.dumps({"metric": "headline_total", "value": value, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
