"""What the operators share: settled tables, ranks without a hot task, components, byte and word arrays."""

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed random words, so hashes agree between workers and runs.
_RNG = np.random.default_rng(20240601)
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a session in one process (master local) gets a folder of
    its own; on a cluster that is an error, as executors would not see it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: later jobs don't depend on any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more; where the session has no JVM at hand, it stays."""
    spark, path = df.sparkSession, getattr(df, "_vecloom_path", None)
    if path and getattr(spark, "_jvm", None):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """A table's size: the optimizer's estimate from its files, or half its text where it has none to go by (joins, rows of a driver)."""
    if getattr(df, "_jdf", None) is not None:
        plan = df._jdf.queryExecution().optimizedPlan()
        size = int(str(plan.stats().sizeInBytes()))
        if plan.collectLeaves().length() == 1 and size < 1 << 60:
            return size
    return (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2


def deal(df: DataFrame, text: str = "text") -> int:
    """How many groups to deal a table into: 4 MB of files each at half a GB, up to 16 MB as it grows.

    Messages between groups grow with the square of their number, until there
    is one for each key, so groups grow with the root of the input. Never under
    the shuffle partitions; twice as many would make four times the messages on
    tables that are small.
    """
    size = input_bytes(df, text)
    each = min(16 << 20, max(4 << 20, int((4 << 20) * (size / 5e8) ** 0.5)))
    return int(max(size // each, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def whole_numbers(df: DataFrame, id_col: str) -> str:
    """The type of an id column, which must be of whole numbers: their order and their least are part of results."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must be a column of whole numbers, got {kind.simpleString()}")
    return kind.simpleString()


def with_rank(df: DataFrame, keys: list[str], bucket: str, order: list, rank: str, total: str | None = None) -> DataFrame:
    """The 0-based rank of each row within its key, in the order of ``bucket`` and then ``order``.

    Only rows of one (key, bucket) meet in a task, so a hot key is spread over
    its buckets; the counts of buckets, a small table, give each its first
    rank. Keys and bucket must not be null.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    base = counts.select(*keys, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), *([F.sum("__n").over(whole).alias(total)] if total else []))
    numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    return numbered.join(base, [*keys, bucket]).withColumn(rank, F.col("__base") + F.col("__rn") - 1).drop("__base", "__rn")


#: Into how many parts the rows of a key are dealt where a value of the whole key goes back to them.
SALTS = 64


def with_whole(df: DataFrame, key: str, by: str, part, whole, out: str) -> DataFrame:
    """df with a value of each key: ``whole`` (a function of a column) over the ``part`` values of the key's salts.

    Rows of a hot key are dealt by a hash of ``by``; at most SALTS rows of one
    key meet in a task, and no join is on the key alone. Keys must not be null.
    """
    salted = df.withColumn("__s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "__s").agg(part.alias("__m"))
    parts = parts.select(key, "__s", whole("__m").over(Window.partitionBy(key)).alias(out))
    return salted.join(parts, [key, "__s"]).drop("__s")


#: Up to so many edges, a megabyte, are joined in one task; a round of a larger table takes nine shuffles.
LOCAL = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node that is reachable.

    Large-star and small-star rounds on settled tables: each node's smallest
    neighbour comes from an aggregate with map-side combine, and goes back to
    salted rows, so a node that a third of all edges meet is spread over tasks.
    Rounds end when the edges are stars, or so few (LOCAL) that one task joins
    them: each shuffle costs the driver a thread for a minute and megabytes for
    its stage, however small the table. No more edges than that are ever
    gathered in a task, none in the driver.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while e.count() > LOCAL:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stars: nobody has two centres, and no centre has one
        ends = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
        if ends.where("m < u and n > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        low = with_whole(both, "u", "v", F.min("v"), F.min, "m")
        large = low.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = with_whole(large, "u", "v", F.min("v"), F.min, "m")
        small = low.select(F.explode(F.expr("if(v = m, array(struct(u, m as v)), array(struct(u, m as v), struct(v as u, m as v)))")).alias("e"))
        out = settle(small.select("e.*").distinct())
        drop_settled(e)
        e = out

    def join(batches):
        held = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches]
        if held:
            nodes, at = np.unique(np.concatenate(held, 1), return_inverse=True)
            u, v = at.reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[local_roots(len(nodes), u, v)])], names=["node", "root"])

    return e.coalesce(1).mapInArrow(join, "node long, root long")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the edges a-b, by pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        lo = np.minimum(ra, rb)
        np.minimum.at(root, ra, lo)
        np.minimum.at(root, rb, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def release() -> None:
    """Give freed memory of this worker back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches, rows: int = 2048):
    """The batches in slices of at most ``rows``, memory given back after each batch."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
        release()


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column on end, and the n+1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if not (pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    buf = texts.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buf[2], dtype=np.uint8)[off[0] : off[-1]] if buf[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; the longest so far is kept up to 2^20."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) == 1 << 20:
            _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, off: np.ndarray, lower: bool, table: np.ndarray = BYTE_HASH, base: np.uint64 = BASE, step: int = 1 << 20):
    """Words [^\\x20\\x09-\\x0D]+ of each text: their hashes, starts and ends in ``data``, and first word of each text (n+1).

    About ``step`` bytes of whole texts at a time, so that the 64-bit arrays
    beside the bytes stay small.
    """
    parts, at = [], 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + step, side="right")) - 1)
        h, start, end = _words(data[off[at] : off[to]], off[at : to + 1] - off[at], lower, table, base)
        parts.append((h, start + off[at], end + off[at]))
        at = to
    if not parts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    h, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, start, end, np.searchsorted(start, off)


def _words(data, off, lower, table, base):
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    if lower:
        data = _LOWER[data]
    in_word = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first = in_word.copy()
    first[1:] &= ~in_word[:-1] | cut[1:n]
    last = in_word.copy()
    last[:-1] &= ~in_word[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # sum of byte codes x base^position; taken from the word's start by the inverse power
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * powers(n, base), out=acc[1:])
    h = (acc[end] - acc[start]) * powers(n, inverse(base))[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words on end; k-1 fewer than words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = mix(g * np.uint64(0xD1342543DE82EF95) + h[j : j + n])
    return g


def table_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], (pa.Array,)) else cols[f.name].cast(f.type) for f in schema], schema=schema)
