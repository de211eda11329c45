"""Two rounds of messages between blocks of documents and buckets of hashes.

Documents are dealt by id into blocks of a few megabytes. A block sends each
bucket the hashes that belong there, once per block however often they occur,
so a passage that a third of all documents share costs a bucket one entry a
block. Buckets answer blocks. The text moves in one exchange, which the plan
uses again for every round; messages are packed arrays, a row per block and
bucket.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import deal, release

MESSAGE = "block int, bucket int, kind int, a binary, b binary, c binary"
_SCHEMA = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def blocked(df: DataFrame, id_col: str, text: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(block, id, text, extra) with about 4 MB of input a block, and the number of blocks; rows of one id and different texts are spread."""
    n = deal(df, text)
    h = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(n)).cast("int")
    return df.select(h.alias("block"), F.col(id_col).alias("id"), F.col(text).alias("text"), *extra), n


def messages(rows: list[tuple]) -> pa.Table:
    """Rows (block, bucket, kind, a, b, c); arrays are sent as their bytes."""
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    raw = [[None if x is None else x.tobytes() if isinstance(x, np.ndarray) else bytes(x) for x in c] for c in cols[3:]]
    return pa.table([pa.array(list(c), pa.int32()) for c in cols[:3]] + [pa.array(c, pa.binary()) for c in raw], schema=_SCHEMA)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def dealt(keys: np.ndarray, n: int):
    """Order that puts keys by bucket, and the (bucket, begin, end) stretches there."""
    b = bucket_of(keys, n)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(n + 1))
    return order, [(int(k), cut[k], cut[k + 1]) for k in np.flatnonzero(cut[1:] > cut[:-1])]


def once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and whether each is there twice or more."""
    u, n = np.unique(keys, return_counts=True)
    return u, n > 1


def arrays(table: pa.Table, column: str, dtype) -> list[np.ndarray]:
    size = np.dtype(dtype).itemsize
    return [np.frombuffer(x.as_buffer(), dtype=dtype) if x.is_valid and x.as_buffer().size % size == 0 else np.zeros(0, dtype) for x in table.column(column)]


def repeated_keys(table: pa.Table, dtypes: dict, hot: int) -> pa.Table:
    """A bucket's answer to key messages (a: keys, b: how often in the block): per block the keys that are anywhere else or twice.

    a: those keys; b: whether the block is the smallest that holds the key; c: whether it is there more than ``hot`` times.
    """
    blocks, kinds = table.column("block").to_pylist(), table.column("kind").to_pylist()
    times, rows = arrays(table, "b", np.uint32), []
    for kind in sorted(set(kinds)):
        keys = arrays(table, "a", dtypes.get(kind, np.uint64))
        mine = [k for k, x in enumerate(kinds) if x == kind]
        flat, n = np.concatenate([keys[k] for k in mine]), np.concatenate([times[k] for k in mine]).astype(np.int64)
        u, inverse = np.unique(flat, return_inverse=True)
        n = np.bincount(inverse, n, len(u))
        owner = np.repeat(np.array([blocks[k] for k in mine]), [len(keys[k]) for k in mine])
        leader = np.full(len(u), 1 << 30)
        np.minimum.at(leader, inverse, owner)
        ok, leads, crowded, at = n[inverse] > 1, leader[inverse] == owner, n[inverse] > hot, 0
        for k in mine:
            stretch = slice(at, at + len(keys[k]))
            at += len(keys[k])
            if ok[stretch].any():
                rows.append((blocks[k], table.column("bucket")[0].as_py(), kind, keys[k][ok[stretch]], leads[stretch][ok[stretch]], crowded[stretch][ok[stretch]]))
    return messages(rows)


def group_messages(df: DataFrame, key: str, f, schema: str = MESSAGE) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        release()
        return out

    return df.groupBy(key).applyInArrow(run, schema)


def answer(docs: DataFrame, replies: DataFrame, f, schema: str = MESSAGE) -> DataFrame:
    """f(documents of a block, replies to it)."""

    def run(table: pa.Table, messages_: pa.Table) -> pa.Table:
        out = f(table, messages_)
        release()
        return out

    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def answer_buckets(sent: DataFrame, held: DataFrame, f, schema: str = MESSAGE) -> DataFrame:
    """f(messages to a bucket, what the bucket holds)."""

    def run(table: pa.Table, own: pa.Table) -> pa.Table:
        out = f(table, own)
        release()
        return out

    return sent.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(run, schema)


def concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of True."""
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each w values on end."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, x[-1], x.dtype)]).reshape(-1, w)
    head = f.accumulate(y, axis=1).ravel()
    tail = f.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(tail[: n - w + 1], head[w - 1 : n])


def anchors(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest hash of some w on end: of any two equal stretches, the same ones."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = sliding(h, w, np.minimum)
    # a position is chosen if the largest of the minima over it is its own hash
    edge = np.zeros(w - 1, h.dtype)
    most = sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero(most == h)
