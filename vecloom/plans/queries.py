"""The registered queries over the data tables, each beside its SQL for DuckDB.

Float inputs of sums are scaled to integers so that both engines agree to the
last bit whatever the order of addition.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import clip, convolve, histogram, vertical
from vecloom.operators import diff_rows, join_between, vertical_agg
from vecloom.plans.psth import psth
from vecloom.sources import table

_SCALED = "transform(embedding, x -> cast(round(cast(x as double) * 1000000) as bigint)) AS v"
_SQL_SCALED = "list_transform(embedding, lambda x: round(x::double * 1000000)::bigint)"
_DAY, _HOURS = 86_400_000_000, 6 * 3_600_000_000
_EPOCH0 = 1_704_067_200_000_000  # 2024-01-01, the first day of events
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _scaled(spark, d):
    return table(spark, d, "embeddings", "label", "vec_id", "embedding").selectExpr("label", "vec_id", _SCALED)


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, value) of the list column v."""
    return df.select(*keys, F.posexplode("v").alias("pos", "value"))


def _flat_sql(inner: str, keys: str, cast: str = "bigint") -> str:
    return f"SELECT {keys}, (generate_subscripts(v, 1) - 1)::int AS pos, unnest(v)::{cast} AS value FROM ({inner})"


def _agg_sql(op: str) -> str:
    return f"SELECT label, pos, {op} AS value FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::int AS pos, unnest({_SQL_SCALED}) AS x FROM embeddings) GROUP BY label, pos"


def _agg(op):
    return lambda spark, d: _flat(vertical_agg(_scaled(spark, d), "label", {"v": ("v", op)}), "label")


for _name, _op, _sql in (
    ("vec_sum", "sum", "coalesce(sum(x), 0)::bigint"), ("vec_mean", "mean", "sum(x)::double / count(x)"), ("vec_avg", "avg", "sum(x)::double / count(x)"),
    ("vec_min", "min", "min(x)"), ("vec_max", "max", "max(x)"), ("vec_count", "count", "count(x)"),
):
    QUERIES[_name], ORACLE[_name] = _agg(_op), _agg_sql(_sql)
for _name, _op in (("vec_std", "std"), ("vec_median", "median")):
    QUERIES[_name] = lambda spark, d, op=_op: _flat(vertical_agg(_scaled(spark, d), "label", {"v": ("v", op)}), "label").withColumn("value", F.round("value", 2))
    ORACLE[_name] = _agg_sql({"std": "round(stddev_samp(x), 2)", "median": "round(median(x), 2)"}[_op])


def _plain(spark, d, kind: str):
    """The vectors as they are, floats or doubles."""
    return table(spark, d, "embeddings", "label", "embedding").select("label", F.col("embedding").cast(f"array<{kind}>").alias("v"))


def _plain_sql(op: str, kind: str) -> str:
    return f"SELECT label, pos, {op} AS value FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::int AS pos, unnest(embedding)::{kind} AS x FROM embeddings) GROUP BY label, pos"


# sums of squares and of floats differ in their last bits by order: rounded far above those
@query(_agg_sql("round(var_samp(x) / 1e12, 9)"))
def vec_var(spark, d):
    return _flat(vertical_agg(_scaled(spark, d), "label", {"v": ("v", "var")}), "label").withColumn("value", F.round(F.col("value") / 1e12, 9))


@query("SELECT label, pos, round(ln(abs(product(x))), 8) AS value FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::int AS pos, unnest(embedding)::double / 4.0::double + 1.0::double AS x FROM embeddings) GROUP BY label, pos")
def vec_prod(spark, d):
    near = _plain(spark, d, "double").withColumn("v", F.transform("v", lambda x: x / 4.0 + 1.0))
    return _flat(vertical_agg(near, "label", {"v": ("v", "prod")}), "label").withColumn("value", F.round(F.ln(F.abs("value")), 8))


for _kind in ("float", "double"):
    for _op, _sql in (("sum", f"sum(x::double)::{_kind}::double"), ("mean", "sum(x::double) / count(x)"), ("min", "min(x)::double"), ("max", "max(x)::double")):
        QUERIES[f"vec_{_op}_{_kind}"] = lambda spark, d, op=_op, kind=_kind: _flat(vertical_agg(_plain(spark, d, kind), "label", {"v": ("v", op)}), "label").withColumn("value", F.round(F.col("value").cast("double"), 5))
        ORACLE[f"vec_{_op}_{_kind}"] = _plain_sql(f"round({_sql}, 5)", _kind)


@query("SELECT label, pos, sum(x)::bigint AS total, max(x) AS most, sum(y)::bigint AS shifted FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::int AS pos, unnest(" + _SQL_SCALED + ") AS x, unnest(" + _SQL_SCALED + ") + 1 AS y FROM embeddings) GROUP BY label, pos")
def vec_agg_columns(spark, d):
    two = _scaled(spark, d).withColumn("w", F.transform("v", lambda x: x + 1))
    out = vertical_agg(two, "label", {"a": ("v", "sum"), "b": ("v", "max"), "c": ("w", "sum")})
    return out.select("label", F.posexplode(F.arrays_zip("a", "b", "c")).alias("pos", "z")).select("label", "pos", F.col("z.a").alias("total"), F.col("z.b").alias("most"), F.col("z.c").alias("shifted"))


@query(_agg_sql("coalesce(sum(x), 0)::bigint"))
def vec_sum_fixed(spark, d):
    return _flat(vertical_agg(_scaled(spark, d), "label", {"v": ("v", "sum")}, length=64), "label")


@query(_agg_sql("max(x)"))
def vec_max_column(spark, d):
    return _flat(_scaled(spark, d).groupBy("label").agg(vertical.max("v").alias("v")), "label")


@query(_agg_sql("coalesce(sum(x), 0)::bigint"))
def vec_sum_column(spark, d):
    return _flat(_scaled(spark, d).groupBy("label").agg(vertical.sum("v").alias("v")), "label")


@query(_agg_sql("sum(x)::double / count(x)"))
def vec_mean_column(spark, d):
    return _flat(_scaled(spark, d).groupBy("label").agg(vertical.mean("v").alias("v")), "label")


@query(_agg_sql("min(x)"))
def vec_min_column(spark, d):
    return _flat(_scaled(spark, d).groupBy("label").agg(vertical.min("v").alias("v")), "label")


@query(_agg_sql("coalesce(sum(x), 0)::bigint").replace("label, pos", "pos").replace("SELECT label, pos", "SELECT pos"))
def vec_sum_global(spark, d):
    return _flat(vertical_agg(_scaled(spark, d), [], {"v": ("v", "sum")}))


_DIFF = f"SELECT label, vec_id, CASE WHEN p IS NULL THEN list_transform(v, lambda x: NULL::bigint) ELSE list_transform(range(1, len(v) + 1), lambda i: v[i] - p[i]) END AS v FROM (SELECT label, vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM (SELECT label, vec_id, {_SQL_SCALED} AS v FROM embeddings))"


@query(_flat_sql(_DIFF, "label, vec_id"))
def vec_diff(spark, d):
    return _flat(diff_rows(_scaled(spark, d), "v", "vec_id", "label"), "label", "vec_id")


def _conv_sql(mode_len: str, off: int, k: list[float]) -> str:
    terms = " + ".join(f"(CASE WHEN n + {off - j} >= 0 AND n + {off - j} < len(e) THEN e[n + {off - j} + 1]::double ELSE 0.0 END) * {x}::double" for j, x in reversed(list(enumerate(k))))
    return _flat_sql(f"SELECT vec_id, list_transform(range(0, {mode_len}), lambda n: 0.0::double + {terms}) AS v FROM (SELECT vec_id, embedding AS e FROM embeddings)", "vec_id", "double")


_K = [0.25, 0.5, 0.25, 0.125]
for _mode, _len, _off in (("full", "len(e) + 3", 0), ("same", "len(e)", 1), ("valid", "len(e) - 3", 3), ("left", "len(e)", 0), ("right", "len(e)", 3)):
    QUERIES[f"vec_convolve_{_mode}"] = lambda spark, d, m=_mode: _flat(table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", convolve("embedding", _K, mode=m).alias("v")), "vec_id")
    ORACLE[f"vec_convolve_{_mode}"] = _conv_sql(_len, _off, _K)


def _emb(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding")


_BINS = "SELECT vec_id, list_transform(range(0, 8), lambda k: len(list_filter(embedding, lambda x: least(floor((x::double - list_min(embedding)::double) * (8::double / (list_max(embedding)::double - list_min(embedding)::double)))::int, 7) = k))) AS v FROM embeddings"
_RANGE = "SELECT vec_id, list_transform(range(0, 10), lambda k: len(list_filter(embedding, lambda x: x::double >= -0.5 AND x::double <= 0.5 AND least(floor((x::double + 0.5) * 10.0::double)::int, 9) = k))) AS v FROM embeddings"
_EDGES = "SELECT vec_id, [len(list_filter(embedding, lambda x: x::double >= -0.5 AND x::double < -0.1)), len(list_filter(embedding, lambda x: x::double >= -0.1 AND x::double < 0.0)), len(list_filter(embedding, lambda x: x::double >= 0.0 AND x::double <= 0.5))] AS v FROM embeddings"


@query(_flat_sql(_BINS, "vec_id"))
def vec_histogram_bins(spark, d):
    return _flat(_emb(spark, d).select("vec_id", histogram("embedding", 8).alias("v")), "vec_id")


@query(_flat_sql(_BINS, "vec_id"))
def vec_histogram_bins_expr(spark, d):
    return _flat(_emb(spark, d).select("vec_id", histogram("embedding", 8, engine="expr").alias("v")), "vec_id")


@query(_flat_sql(_RANGE, "vec_id"))
def vec_histogram_range(spark, d):
    return _flat(_emb(spark, d).select("vec_id", histogram("embedding", start=-0.5, stop=0.5, spacing=0.1).alias("v")), "vec_id")


@query(_flat_sql(_EDGES, "vec_id"))
def vec_histogram_edges(spark, d):
    return _flat(_emb(spark, d).select("vec_id", histogram("embedding", [-0.5, -0.1, 0.0, 0.5]).alias("v")), "vec_id")


@query(_flat_sql(_EDGES.replace(")), len", ")) > 0, len").replace("0.5))]", "0.5)) > 0]"), "vec_id", "boolean"))
def vec_histogram_bool(spark, d):
    return _flat(_emb(spark, d).select("vec_id", histogram("embedding", [-0.5, -0.1, 0.0, 0.5], count_dtype="bool").alias("v")), "vec_id")


@query(_flat_sql("SELECT vec_id, list_transform(range(0, 2 + (vec_id % 5)), lambda k: len(list_filter(embedding, lambda x: least(floor((x::double - list_min(embedding)::double) * ((2 + (vec_id % 5))::double / (list_max(embedding)::double - list_min(embedding)::double)))::bigint, 1 + (vec_id % 5)) = k))) AS v FROM embeddings", "vec_id"))
def vec_histogram_per_row(spark, d):
    return _flat(_emb(spark, d).select("vec_id", histogram("embedding", F.expr("2 + vec_id % 5")).alias("v")), "vec_id")


@query("SELECT vec_id, pos, breakpoint, count FROM (SELECT vec_id, generate_subscripts(c, 1) - 1 AS p, unnest(c) AS count, unnest([-0.5::double, -0.1, 0.0]) AS breakpoint, (generate_subscripts(c, 1) - 1)::int AS pos FROM (SELECT vec_id, v AS c FROM (" + _EDGES + ")))")
def vec_histogram_breakpoints(spark, d):
    h = _emb(spark, d).select("vec_id", histogram("embedding", [-0.5, -0.1, 0.0, 0.5], include_breakpoints=True).alias("h"))
    return h.select("vec_id", F.posexplode("h.counts").alias("pos", "count"), F.col("h.breakpoints").alias("b")).select("vec_id", "pos", F.get("b", F.col("pos")).alias("breakpoint"), "count")


def _units(spark, d, *keys):
    keys = keys or ("user_id",)
    t = table(spark, d, "events", *keys, "ts").select(*keys, (F.unix_micros(F.col("ts").cast("timestamp")) - _EPOCH0).alias("t"))
    return t.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("times"))


def _days(spark):
    return spark.range(30).select(F.col("id").cast("int").alias("iid"), (F.col("id") * _DAY).alias("a"), (F.col("id") * _DAY + _HOURS).alias("b"))


_U = f"(SELECT user_id, list(epoch_us(ts) - {_EPOCH0} ORDER BY ts) AS times FROM events GROUP BY user_id)"
_I = f"(SELECT i::int AS iid, i * {_DAY} AS a, i * {_DAY} + {_HOURS} AS b FROM range(30) t(i))"
_HITS = "list_filter(times, lambda x: x >= a AND x < b)"


@query(f"SELECT user_id, iid, len({_HITS}) AS n FROM {_U}, {_I}")
def join_between_counts(spark, d):
    return join_between(_units(spark, d), _days(spark), "times", ("a", "b"), as_counts=True).select("user_id", "iid", F.col("times").alias("n"))


@query(f"SELECT user_id, iid, unnest({_HITS}) AS t FROM {_U}, {_I}")
def join_between_cross(spark, d):
    return join_between(_units(spark, d), _days(spark), "times", ("a", "b")).select("user_id", "iid", F.explode("times").alias("t"))


@query(f"SELECT user_id, iid, unnest(list_transform({_HITS}, lambda x: x - a)) AS t FROM {_U}, {_I}")
def join_between_relative(spark, d):
    return join_between(_units(spark, d), _days(spark), "times", ("a", "b"), relative=True).select("user_id", "iid", F.explode("times").alias("t"))


@query(f"SELECT user_id, iid, len(list_filter(times, lambda x: x >= a AND x < {10 * _DAY})) AS n FROM {_U}, {_I}")
def join_between_literal_bounds(spark, d):
    return join_between(_units(spark, d), _days(spark), "times", ("a", 10 * _DAY), as_counts=True).select("user_id", "iid", F.col("times").alias("n"))


_TYPED = "(SELECT user_id, event_type, list(epoch_us(ts) - {0} ORDER BY ts) AS times FROM events GROUP BY user_id, event_type)".format(_EPOCH0)
_KEYED_I = f"(SELECT event_type, i::int AS iid, i * {_DAY} AS a, i * {_DAY} + {_HOURS} AS b FROM (SELECT DISTINCT event_type FROM events), range(30) t(i))"


@query(f"SELECT user_id, event_type, iid, len({_HITS}) AS n FROM {_TYPED} u JOIN {_KEYED_I} USING (event_type)")
def join_between_keyed(spark, d):
    kinds = table(spark, d, "events", "event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("iid"))
    spans = kinds.select("event_type", "iid", (F.col("iid") * F.lit(_DAY)).alias("a"), (F.col("iid") * F.lit(_DAY) + _HOURS).alias("b"))
    return join_between(_units(spark, d, "user_id", "event_type"), spans, "times", ("a", "b"), on="event_type", as_counts=True).select("user_id", "event_type", "iid", F.col("times").alias("n"))


_PSTH = f"SELECT user_id, pos::int AS pos, avg(len(list_filter({_HITS}, lambda x: least(floor((x - a)::double * (6::double / {float(_HOURS)}::double))::int, 5) = pos))) AS mean_count FROM {_U}, {_I}, range(6) p(pos) GROUP BY user_id, pos"


_OWN = "(SELECT user_id, times, times[1] + 100 * {0} AS a, times[1] + 400 * {0} AS b FROM {1})".format(3_600_000_000, _U)


@query(f"SELECT user_id, unnest(list_transform({_HITS}, lambda x: x - a)) AS t FROM {_OWN}")
def vec_clip(spark, d):
    hour, first = 3_600_000_000, F.get("times", F.lit(0))
    return _units(spark, d).select("user_id", F.explode(clip("times", first + 100 * hour, first + 400 * hour, relative=True)).alias("t"))


@query(f"SELECT user_id, len({_HITS}) AS n FROM {_OWN}")
def vec_clip_counts(spark, d):
    hour, first = 3_600_000_000, F.get("times", F.lit(0))
    return _units(spark, d).select("user_id", clip("times", first + 100 * hour, first + 400 * hour, as_counts=True).alias("n"))


@query(_PSTH)
def psth_by_user(spark, d):
    return psth(_units(spark, d), _days(spark), "user_id", "times", ("a", "b"), 0.0, float(_HOURS), float(_HOURS) / 6)


@query("SELECT event_id, coalesce((value - p)::double, NULL) AS value FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def vec_diff_events(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", "user_id", "ts", F.array("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.get(vertical.diff("v", window=w), F.lit(0)).alias("value"))
