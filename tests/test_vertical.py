import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import vecloom as vl

L = "a array<bigint>"


def agg(spark, rows, op, schema=L, length=None):
    return [r[0] for r in vl.vertical_agg(spark.createDataFrame([(x,) for x in rows], schema), [], {"v": ("a", op)}, length).collect()]


def col(spark, rows, f, schema=L):
    return spark.createDataFrame([(x,) for x in rows], schema).agg(f("a").alias("v")).collect()[0][0]


CASES = [
    ([[4, -3], [6, 8], [-1, 1]], [9, 6], [3.0, 2.0], [-1, -3], [6, 8]),
    ([None, [12, 0, -7], None, [3, 40, 9]], [15, 40, 2], [7.5, 20.0, 1.0], [3, 0, -7], [12, 40, 9]),
    ([[None, 6, 11], [20, None, 1], [2, -4, None], [None, 4, None]], [22, 6, 12], [11.0, 2.0, 6.0], [2, -4, 1], [20, 6, 11]),
    ([[-8, 64]], [-8, 64], [-8.0, 64.0], [-8, 64], [-8, 64]),
    ([[], None, []], [], [], [], []),
]


@pytest.mark.parametrize("rows,sum_,mean,min_,max_", CASES)
def test_forms_agree(spark, rows, sum_, mean, min_, max_):
    for op, f, want in (("sum", vl.sum, sum_), ("mean", vl.mean, mean), ("min", vl.min, min_), ("max", vl.max, max_)):
        assert agg(spark, rows, op) == [want]
        assert agg(spark, rows, op, length=3) == [want]
        assert col(spark, rows, f) == want


def test_position_null_throughout(spark):
    rows = [[1, None], [2, None]]
    assert agg(spark, rows, "sum") == [[3, 0]] and col(spark, rows, vl.sum) == [3, 0]
    for x in (agg(spark, rows, "mean")[0][1], col(spark, rows, vl.mean)[1]):
        assert math.isnan(x)
    assert agg(spark, rows, "min") == [[1, None]] and col(spark, rows, vl.max) == [2, None]


def test_null_rows_only_and_none(spark):
    assert agg(spark, [None, None], "sum") == [None]
    assert col(spark, [None], vl.mean) is None
    assert agg(spark, [], "sum") == []
    assert agg(spark, [], "sum", length=2) == []


def test_ragged_is_an_error(spark):
    for f in (lambda: agg(spark, [[1, 2], [1]], "sum"), lambda: col(spark, [[1, 2], [1]], vl.sum), lambda: agg(spark, [[1, 2], [1]], "max", length=2)):
        with pytest.raises(Exception, match="same length"):
            f()


def test_types_and_groups(spark):
    df = spark.createDataFrame([("x", [1.5, 2.5], [1]), ("x", [0.5, 1.0], [2]), (None, [1.0, 1.0], [5])], "g string, a array<float>, b array<int>")
    out = vl.vertical_agg(df, "g", {"s": ("a", "sum"), "m": ("b", "max"), "c": ("a", "mean")})
    assert out.schema["s"].dataType.elementType.simpleString() == "float" and out.schema["m"].dataType.elementType.simpleString() == "int"
    assert sorted(map(tuple, out.collect()), key=str) == [("x", [2.0, 3.5], [2], [1.0, 1.75]), (None, [1.0, 1.0], [5], [1.0, 1.0])]
    with pytest.raises(TypeError):
        vl.vertical_agg(df, [], {"s": ("g", "sum")})
    assert isinstance(vl.sum("a", "b"), list)


def test_grouped_large(spark):
    df = spark.range(2000).select((F.col("id") % 20).alias("g"), F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: (i + F.col("id")).cast("double")).alias("a"))
    got = {r["g"]: r["s"] for r in vl.vertical_agg(df, "g", {"s": ("a", "sum")}).collect()}
    assert all(got[g][p] == sum(p + i for i in range(g, 2000, 20)) for g in range(20) for p in range(50))


def test_diff(spark):
    df = spark.createDataFrame([(0, [40, 7]), (1, [38, 11]), (2, [-2, 11]), (3, None), (4, [9, None])], "k int, a array<bigint>")
    n = [None] * 2
    assert [r["a"] for r in vl.diff_rows(df, "a", "k").orderBy("k").collect()] == [n, [-2, 4], [-40, 0], n, n]
    with pytest.raises(Exception, match="same length"):
        vl.diff_rows(spark.createDataFrame([(0, [1, 2]), (1, [1])], "k int, a array<bigint>"), "a", "k").collect()
    nulls = spark.createDataFrame([(0, None)], "k int, a array<bigint>")
    assert vl.diff_rows(nulls, "a", "k").collect()[0]["a"] is None
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.where("k < 3").select("k", vl.sum("a", window=w).alias("s")).orderBy("k").collect()
    assert run[2]["s"] == [76, 29]


def test_columns_of_other_lengths(spark):
    rows = [("x", [1, 2, 3], [0.5], None), ("x", [4, None, 6], [1.5], None), ("y", None, [], [1, 1]), ("y", [7], None, [2, 3]), (None, [], [2.0, 4.0], [5])]
    df = spark.createDataFrame(rows, "g string, a array<bigint>, b array<double>, c array<int>")
    got = {r["g"]: tuple(r)[1:] for r in vl.vertical_agg(df, "g", {"s": ("a", "sum"), "m": ("b", "mean"), "h": ("c", "max"), "n": ("a", "count")}).collect()}
    assert got == {"x": ([5, 2, 9], [1.0], None, [2, 1, 2]), "y": ([7], [], [2, 3], [1]), None: ([], [2.0, 4.0], [5], [])}
    with pytest.raises(Exception, match="same length"):
        vl.vertical_agg(df.union(df.selectExpr("g", "slice(a, 1, 1)", "b", "c")), "g", {"s": ("a", "sum"), "m": ("b", "mean")}).collect()


def test_methods(spark):
    df = spark.createDataFrame([("x", [1.0, 2.0, 4.0]), ("x", [3.0, 3.0, 5.0])], "g string, a array<double>")
    v = vl.Vec(df)
    assert v.sum("a", by="g").collect()[0]["a"] == [4.0, 5.0, 9.0] and v.mean("a").collect()[0]["a"] == [2.0, 2.5, 4.5]
    assert v.min("a").collect()[0]["a"] == [1.0, 2.0, 4.0] and v.max("a").collect()[0]["a"] == [3.0, 3.0, 5.0]
    assert [r["h"] for r in v.histogram("a", 2, out="h").collect()] == [[2, 1], [2, 1]]
    assert v.convolve("a", [1.0], mode="left").collect()[0]["a"] == [1.0, 2.0, 4.0]
    assert [r["a"] for r in v.clip("a", 2, 4).collect()] == [[2.0], [3.0, 3.0]]
    assert v.running("sum", "a", Window.partitionBy("g"), out="s").collect()[0]["s"] == [4.0, 5.0, 9.0]
