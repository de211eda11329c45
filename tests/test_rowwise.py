import numpy as np
import pytest
from pyspark.sql import functions as F

import vecloom as vl


def one(spark, rows, c, schema="a array<double>"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(c.alias("r")).collect()]


def fl(*xs):
    return [float(x) for x in xs]


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolve_as_numpy(spark, mode):
    x, k = fl(-2, 9, 0, 7, 7, -11, 30), [0.5, -1.5, 2.0]
    assert np.allclose(one(spark, [x], vl.convolve("a", k, mode=mode))[0], np.convolve(x, k, mode), atol=1e-10)


def test_convolve_rules(spark):
    x = fl(1, 2, 3)
    assert one(spark, [x], vl.convolve("a", [1, 10], mode="left")) == [fl(1, 12, 23)]
    assert one(spark, [x], vl.convolve("a", [1, 10], mode="right")) == [fl(12, 23, 30)]
    assert one(spark, [x], vl.convolve("a", [1] * 5)) == [fl(6, 6, 6, 5, 3)]
    assert one(spark, [x], vl.convolve("a", [1] * 5, mode="valid")) == [fl(6, 5, 3)]
    assert one(spark, [None, [], [5.0]], vl.convolve("a", [0.5, 0.5])) == [None, [], [2.5, 2.5]]
    assert one(spark, [[1.0, None, 3.0]], vl.convolve("a", [1.0], fill_value=2)) == [fl(1, 2, 3)]
    assert one(spark, [x], vl.convolve("a", [1, float("nan"), float("inf")])) == [x]
    for bad in (lambda: vl.convolve("a", []), lambda: vl.convolve("a", [1], mode="no")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        vl.convolve("a", F.col("k"))


@pytest.mark.parametrize("engine", ["arrow", "expr"])
def test_histogram_both_engines(spark, engine):
    h = lambda **k: vl.histogram("a", engine=engine, **k)
    x, nan = fl(1, 2, 3, 4, 5), float("nan")
    assert one(spark, [x, None, [], [None, nan, float("inf")], fl(5, 5)], h(bins=3)) == [[2, 1, 2], None, [0, 0, 0], [0, 0, 0], [0, 2, 0]]
    assert one(spark, [x, None, []], h(start=0, stop=6, spacing=2)) == [[1, 2, 2], None, [0, 0, 0]]
    # uniform counting although the last bin is narrower
    assert one(spark, [[3.9]], h(start=0, stop=5, spacing=2)) == [[0, 0, 1]]
    assert len(one(spark, [[3.9]], h(start=0, stop=4.2, spacing=0.7))[0]) == 7
    r = np.random.default_rng(1).normal(size=(20, 100))
    assert one(spark, r.tolist(), h(bins=7)) == [np.histogram(v, 7)[0].tolist() for v in r]
    assert one(spark, [[1, 2, 3, 4, 5]], h(bins=3), "a array<int>") == [[2, 1, 2]]


def test_histogram_edges_and_breakpoints(spark):
    x = fl(1, 2, 3, 4, 5)
    assert one(spark, [x, [1.0, None, 3.0, None, 5.0]], vl.histogram("a", [0, 2.5, 5])) == [[2, 3], [1, 2]]
    got = one(spark, [x, None, fl(5, 5, 5, 5), []], vl.hist("a", 3, include_breakpoints=True))
    assert got[0]["counts"] == [2, 1, 2] and np.allclose(got[0]["breakpoints"], [1, 2.3333333, 3.6666667, 5])
    assert tuple(got[1]) == (None, None) and tuple(got[2]) == ([4.5, 5.5], [4]) and tuple(got[3]) == (None, None)
    assert one(spark, [x], vl.histogram("a", [0, 2.5, 5], count_dtype="bool")) == [[True, True]]
    assert one(spark, [x], vl.histogram("a", 3, count_dtype="u8")) == [[2, 1, 2]]


def test_histogram_per_row(spark):
    df = spark.createDataFrame([(fl(1, 2, 3, 4, 5), 2, 0.0, 6.0, 2.0), (fl(10, 20, 30, 40, 50), 5, 0.0, 60.0, 20.0), (fl(1), None, None, 1.0, 1.0)], "a array<double>, n int, lo double, hi double, s double")
    assert [r[0] for r in df.select(vl.histogram("a", "n")).collect()] == [[2, 3], [1] * 5, None]
    assert [r[0] for r in df.select(vl.histogram("a", start="lo", stop="hi", spacing=F.col("s"))).collect()] == [[1, 2, 2], [1, 2, 2], None]


def test_histogram_arguments():
    for k, text in (({"bins": 2, "start": 0}, "Cannot specify both"), ({}, "Must specify either"), ({"start": 0}, "Missing"), ({"bins": 0}, "positive"), ({"bins": [1]}, "edges"), ({"start": 1, "stop": 0, "spacing": 1}, "less than")):
        with pytest.raises(ValueError, match=text):
            vl.histogram("a", **k)
    for k in ({"bins": True}, {"bins": (1, 2)}, {"bins": 2, "count_dtype": "i9"}):
        with pytest.raises(TypeError):
            vl.histogram("a", **k)
