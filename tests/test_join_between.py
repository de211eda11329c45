import pytest
from pyspark.sql import functions as F

from vecloom import Vec, clip, join_between
from vecloom.functions.clip import lower_bound


@pytest.fixture
def sensors(spark):
    return spark.createDataFrame([("north", [2.0, 3.5, 3.5, 8.25, 11.0, 19.0]), ("south", [-4.0, 0.0, 8.0])], "sensor string, ticks array<double>")


@pytest.fixture
def shifts(spark):
    return spark.createDataFrame([("early", 0.0, 8.0), ("late", 8.0, 16.0), ("night", 16.0, 24.0)], "shift string, since double, until double")


B = ("since", "until")


def test_cross(sensors, shifts):
    out = Vec(sensors).join_between(shifts, "ticks", B, as_counts=True)
    assert out.columns == ["sensor", "ticks", "shift", "since", "until"]
    assert [r["ticks"] for r in out.orderBy("sensor", "shift").collect()] == [3, 2, 1, 1, 1, 0]
    rel = join_between(sensors, shifts, "ticks", B, relative=True).where("sensor = 'north' and shift = 'late'").first()
    assert rel["ticks"] == [0.25, 3.0]


def test_boundaries_and_nulls(spark, sensors):
    spans = spark.createDataFrame([("at", 2.0, 3.5), ("after", 20.0, 21.0), ("null", None, 1.0), ("turned", 9.0, 3.0)], "shift string, since double, until double")
    got = {r["shift"]: r["ticks"] for r in join_between(sensors.where("sensor = 'north'"), spans, "ticks", B).collect()}
    assert got == {"at": [2.0], "after": [], "null": None, "turned": []}
    odd = spark.createDataFrame([(0, None), (1, []), (2, [0.5, None, 0.75])], "id int, ticks array<double>")
    one = spark.createDataFrame([(0.0, 1.0)], "since double, until double")
    assert [r["ticks"] for r in join_between(odd, one, "ticks", B).orderBy("id").collect()] == [None, [], [0.5, 0.75]]


def test_unsorted(spark, shifts):
    bad = spark.createDataFrame([([9.0, 1.0, None, 17.0],)], "ticks array<double>")
    with pytest.raises(Exception, match="sorted"):
        join_between(bad, shifts, "ticks", B).collect()
    got = join_between(bad, shifts, "ticks", B, check_sortedness=False).orderBy("since").collect()
    assert [r["ticks"] for r in got] == [[1.0], [9.0], [17.0]]


def test_repeated_rows_and_many_chunks(spark):
    """Every row of the other side meets every list, repeated rows as often as they are there."""
    lists = spark.createDataFrame([(k, [float(x) for x in range(k, 300 + k)]) for k in range(3)], "k int, v array<double>")
    spans = spark.createDataFrame([(i % 40, float(i % 40), 2.0 * (i % 40)) for i in range(700)] + [(None, 5.0, 6.0)] * 3, "i int, a double, b double")
    for as_counts in (True, False):
        out = join_between(lists, spans, "v", ("a", "b"), as_counts=as_counts).collect()
        assert len(out) == 3 * 703
        want = sorted((k, -1 if i is None else i, a, b, sum(a <= x < b for x in range(k, 300 + k))) for k in range(3) for i, a, b in map(tuple, spans.collect()))
        assert sorted((r["k"], -1 if r["i"] is None else r["i"], r["a"], r["b"], r["v"] if as_counts else len(r["v"])) for r in out) == want


def test_search_at_any_length(spark):
    sizes = [0, 1, 2, 63, 64, 127, 128, 129, 8191, 8192, 8200]
    df = spark.createDataFrame([(n, [2 * i for i in range(n)]) for n in sizes], "n int, v array<bigint>")
    bounds = [F.lit(-1), F.lit(0), F.lit(1), F.col("n") - 1, F.col("n"), 2 * F.col("n") - 2, 2 * F.col("n") - 1, 2 * F.col("n"), F.lit(99999)]
    for r in df.select("n", F.array(*bounds).alias("at"), F.array(*[lower_bound(F.col("v"), b) for b in bounds]).alias("got")).collect():
        assert r["got"] == [sum(2 * i < b for i in range(r["n"])) for b in r["at"]]


def test_clip(spark):
    nan = float("nan")
    rows = [([1.0, 2.0, 5.0, 9.0], 2.0, 9.0), ([1.0, 2.0], None, 3.0), (None, 0.0, 1.0), ([], 0.0, 1.0), ([3.0, None, 4.0], 3.0, 4.5), ([4.0, 1.0], 0.0, 2.0), ([1.0, nan], 0.0, nan), ([1.0], 2.0, 0.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, v array<double>, a double, b double")
    take = lambda c: [r[0] for r in df.orderBy("k").select(c).collect()]
    assert take(clip("v", "a", "b")) == [[2.0, 5.0], None, None, [], [3.0, 4.0], [1.0], [1.0], []]
    assert take(clip("v", "a", F.col("b"), relative=True)) == [[0.0, 3.0], None, None, [], [0.0, 1.0], [1.0], [1.0], []]
    assert take(clip("v", "a", "b", as_counts=True)) == [2, None, None, 0, 2, 1, 1, 0]
    assert take(clip("v", 1, 5))[0] == [1.0, 2.0]


def test_keyed(spark):
    u = spark.createDataFrame([("p", 7, [1.0, 4.0, 6.5]), ("q", 8, [2.0, 2.5]), (None, 9, [1.0])], "line string, meter int, t array<double>")
    i = spark.createDataFrame([("p", 1, 0.0, 2.0), ("p", 2, 4.0, 9.0), ("q", 3, 2.5, 3.0), ("r", 4, 0.0, 9.0), (None, 5, 0.0, 9.0)], "line string, span int, a double, b double")
    out = join_between(u, i, "t", ("a", "b"), on="line")
    assert out.columns == ["line", "meter", "t", "span", "a", "b"]
    assert [r["t"] for r in out.orderBy("span").collect()] == [[1.0], [4.0, 6.5], [2.5]]
    out = join_between(u, i.withColumnRenamed("line", "track").withColumn("meter", F.lit(0)), "t", ("a", "b"), left_on="line", right_on="track")
    assert out.columns == ["line", "meter", "t", "span", "a", "b", "meter_right"]


def test_expressions_literals_and_types(spark, sensors, shifts):
    shifted = join_between(sensors, shifts, F.transform("ticks", lambda x: x + 1).alias("later"), (F.col("since") + 1, 99.0))
    assert shifted.columns[:3] == ["sensor", "ticks", "later"]
    ints = spark.createDataFrame([(0, [1, 3, 7, 12, 20])], "id int, v array<bigint>")
    two = spark.createDataFrame([(0, 5), (10, 15)], "a bigint, b bigint")
    assert sorted(r["v"] for r in join_between(ints, two, "v", ("a", "b"), relative=True).collect()) == [[1, 3], [2]]


def test_arguments(sensors, shifts):
    for k in ({"on": "a", "left_on": "b", "right_on": "c"}, {"left_on": "a"}, {"left_on": ["a", "b"], "right_on": ["c"]}):
        with pytest.raises(ValueError):
            join_between(sensors, shifts, "ticks", B, **k)
    with pytest.raises(TypeError):
        join_between(sensors, shifts, "ticks", B, on=3)
    with pytest.raises(ValueError, match="both sides"):
        join_between(sensors, shifts.withColumnRenamed("shift", "sensor"), "ticks", B)
