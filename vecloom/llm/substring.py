"""Substring deduplication by a log-structured fingerprint index.

Windows of ``window`` words are fingerprinted by two independent 64-bit hashes,
one to find and one to verify. The index holds sorted immutable runs in a fixed
number of buckets, on shared storage. A table passes in batches of rising ids:
each batch is merge-joined, bucket by bucket, with the runs of the batches and
tables before it; what they hold, or an earlier place of the batch itself, is a
repeat. The batch's new fingerprints become a run, and runs of one level are
compacted into one of the next.

A block of documents asks once for a window however often it holds it, so a
passage that a third of all documents share is one entry a block. Where the
whole table is known, a first pass finds the anchors (smallest hash of 8 words
in a window) that occur twice in it; only windows on those reach the index, as
a window whose anchor occurs once cannot repeat.
"""

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.llm.blocks import MESSAGE, anchors, answer, answer_buckets, arrays, blocked, concat, dealt, group_messages, messages, once, sliding
from vecloom.llm.common import deal, drop_settled, flat_bytes, mix, settle, slices, whole_numbers, words_of

GRAM = 8
_TABLE2 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASE2 = np.uint64(0x2545F4914F6CDD1D)


def merge_join(run: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Which of the batch's fingerprints the run holds too; both are sorted and hold each once."""
    k = np.concatenate([run["k"], batch["k"]])
    order = np.argsort(k, kind="stable")  # merges two ascending stretches
    k, c, own = k[order], np.concatenate([run["c"], batch["c"]])[order], order >= len(run)
    out = np.zeros(len(batch), bool)
    # neighbours of one key: the run's comes first, unless several fingerprints share the key
    same = np.flatnonzero((k[1:] == k[:-1]) & (c[1:] == c[:-1]) & own[1:] & ~own[:-1])
    out[order[same + 1] - len(run)] = True
    crowd = np.flatnonzero((k[2:] == k[:-2])) if len(k) > 2 else same[:0]
    for key in np.unique(k[crowd]).tolist():
        at = slice(*(int(np.searchsorted(k, np.uint64(key), side=s)) for s in ("left", "right")))
        held = set(c[at][~own[at]].tolist())
        out[[x - len(run) for x, y in zip(order[at][own[at]].tolist(), c[at][own[at]].tolist(), strict=True) if y in held]] = True
    return out


def seen_before(flat: np.ndarray, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch's fingerprints in order of document and place, which came earlier, in it or in a run; and the new ones, as a run."""
    order = np.lexsort((flat["c"], flat["k"]))  # stable: the first place comes first
    srt = flat[order]
    first = np.ones(len(srt), bool)
    first[1:] = (srt["k"][1:] != srt["k"][:-1]) | (srt["c"][1:] != srt["c"][:-1])
    batch = srt[first]
    old = np.zeros(len(batch), bool)
    for run in runs:
        old |= merge_join(run, batch)
    repeat = np.zeros(len(flat), bool)
    repeat[order] = ~first | old[np.cumsum(first) - 1]
    return repeat, batch[~old]


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of the different fingerprints of several."""
    flat = np.concatenate(runs) if runs else np.zeros(0, _FINGER)
    flat = flat[np.lexsort((flat["c"], flat["k"]))]
    new = np.ones(len(flat), bool)
    new[1:] = (flat["k"][1:] != flat["k"][:-1]) | (flat["c"][1:] != flat["c"][:-1])
    return flat[new]


def _first(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which fingerprints are not further left in the arrays too."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    out = np.zeros(len(k), bool)
    out[order[new]] = True
    return out


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of numbers on end."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1


def _doubled(h: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of each 2, 4, 8, ... words on end."""
    out, k = {1: h}, 1
    while 2 * k <= max(sizes):
        g = out[k]
        out[2 * k] = mix(g[: max(0, len(g) - k)] * np.uint64(0xD1342543DE82EF95) + g[k:]) if len(g) > k else np.zeros(0, np.uint64)
        k *= 2
    return out


def _window(g: dict[int, np.ndarray], window: int) -> np.ndarray:
    """Hashes of each ``window`` words from those of powers of two."""
    at, h, n = 0, None, len(g[1]) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    for k in sorted((1 << i for i in range(window.bit_length()) if window >> i & 1), reverse=True):
        part = g[k][at : at + n]
        h = part if h is None else mix(h * np.uint64(0x9FB21C651E98DF25) + part)
        at += k
    return h


class _Texts:
    """A block's documents in order of id, as words."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        ids, tie = (np.asarray(table.column(c).combine_chunks().cast(pa.int64()).fill_null(-(1 << 63))) if len(table) else np.zeros(0, np.int64) for c in ("id", "tie"))
        text = table.column("text")
        self.order = np.lexsort((tie, ids))
        self.ids = np.zeros(len(ids), _DOC)
        self.ids["id"], self.ids["tie"] = ids[self.order], tie[self.order]
        self.data, self.off = flat_bytes(text.combine_chunks().take(pa.array(self.order)) if len(table) else pa.array([], pa.string()))
        self.hash, self.start, self.end, self.first = words_of(self.data, self.off, lower=False)
        self.window, self.gram = window, gram
        n = len(self.hash)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.fits = np.zeros(max(0, n - window + 1), bool)  # windows within one document
        if len(self.fits):
            self.fits = self.doc[: len(self.fits)] == self.doc[window - 1 :]
        self.grams = _doubled(self.hash, (max(window, gram),))

    def anchors(self):
        """Positions of anchors, and their hashes; grams across documents only add some."""
        g = self.grams[self.gram]
        at = anchors(g, self.window - self.gram + 1)
        inside = self.doc[at] == self.doc[at + self.gram - 1]
        return at[inside], g[at[inside]]

    def windows(self, alive: np.ndarray | None):
        """Starts of windows whose smallest gram is among ``alive`` (sorted; None: all)."""
        if not len(self.fits):
            return np.zeros(0, np.int64)
        if alive is None:
            return np.flatnonzero(self.fits)
        least = sliding(self.grams[self.gram], self.window - self.gram + 1, np.minimum)
        u, inv = np.unique(least, return_inverse=True)
        return np.flatnonzero(self.fits & np.isin(u, alive, assume_unique=True)[inv])

    def fingerprints(self, at: np.ndarray):
        out = np.zeros(len(at), _FINGER)
        out["k"], out["c"] = _window(self.grams, self.window)[at], _window(_doubled(self._second(), (self.window,)), self.window)[at]
        return out

    def _second(self):
        """Independent hashes of the words."""
        return words_of(self.data, self.off, False, _TABLE2, _BASE2)[0]


def deduplicate(df: DataFrame, window: int = 20, id_col: str = "doc_id", text: str = "text", kept: str | None = None, carry: tuple[str, ...] = (), history: DataFrame | None = None, batches: int = 4) -> DataFrame:
    """Remove each word that a window covers whose words also start earlier (smaller id, or same text further left).

    Returns id_col, n_words, n_removed, kept_sha256 and, with ``kept``, the
    kept words joined by one space; then the columns of ``carry``; others are
    not read. Words are ``[^\\x20\\x09-\\x0D]+``. Null text: no words. Texts
    shorter than a window lose nothing; very long ones are taken whole. Rows of
    one id count in the order of their texts' hashes; equal rows in any. A null
    id comes before all others. Ids must be whole numbers. Windows are judged
    on the input. Empty table: no rows.

    The table passes through the index in ``batches`` of rising ids, whose
    bounds are approximate quantiles; the result is the same for any number.
    ``history``: runs by ``index_of`` of earlier tables, all of which count as
    earlier; of another window, or dealt into different numbers of buckets,
    they are an error. Each batch's result is settled.
    """
    id_type, spark = whole_numbers(df, id_col), df.sparkSession
    named = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    n, least = deal(df, text), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = settings(history, window) if history is not None else n
    alive = settle(_repeated_anchors(named, window, buckets)) if history is None else None
    cuts = named.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({min(int(c), (1 << 63) - 1) for c in cuts}), None]
    blocks = max(-(-n // (len(edges) - 1)), least)
    index, done = Index(spark, window, buckets, history), []
    for lo, hi in zip(edges, edges[1:]):
        part = named
        if lo is not None:
            part = part.where(F.col("id") > lo)
        if hi is not None:
            part = part.where((F.col("id") <= hi) if lo is not None else F.coalesce(F.col("id") <= hi, F.lit(True)))
        out = settle(_judged(part, window, blocks, buckets, kept is not None, len(carry), index.runs(), alive))
        done.append(out.where("run is null"))
        if hi is not None:
            index.add(out.where("run is not null").select("bucket", F.col("run").alias("a")))
    index.drop()
    if alive is not None:
        drop_settled(alive)
    result = functools.reduce(DataFrame.unionByName, done)
    return result.select(F.col("id").cast(id_type).alias(id_col), "n_words", "n_removed", "kept_sha256", *([F.col("kept").alias(kept)] if kept else []), *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)])


#: Runs of one level that are compacted into one of the next.
FAN = 3
RUN = "bucket int, level int, window int, buckets int, a binary"


class Index:
    """Runs of one window and number of buckets, by level, on the session's shared storage."""

    def __init__(self, spark, window: int, buckets: int, history: DataFrame | None = None, fan: int = FAN):
        self.spark, self.window, self.buckets, self.fan, self.history = spark, window, buckets, fan, history
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, run: DataFrame) -> None:
        """A batch's run (bucket, a), which must be settled; compacts as many of one level as ``fan``."""
        self.levels.append((0, run.select("bucket", F.lit(0).alias("level"), F.lit(self.window).alias("window"), F.lit(self.buckets).alias("buckets"), "a")))
        while len(self.levels) >= self.fan and len({level for level, _ in self.levels[-self.fan :]}) == 1:
            last = self.levels[-self.fan :]
            whole = settle(compact(functools.reduce(DataFrame.unionByName, [r for _, r in last]), self.fan))
            self.levels[-self.fan :] = [(last[0][0] + 1, whole)]
            for _, r in last:
                drop_settled(r)

    def runs(self) -> DataFrame:
        """All runs there are, RUN."""
        every = [r for _, r in self.levels] + ([self.history.select("bucket", "level", "window", "buckets", "a")] if self.history is not None else [])
        return functools.reduce(DataFrame.unionByName, every) if every else self.spark.createDataFrame([], RUN)

    def drop(self) -> None:
        for _, r in self.levels:
            drop_settled(r)


def settings(runs: DataFrame, window: int) -> int:
    """The number of buckets that the runs are dealt into; ValueError where they are of another window or of several numbers."""
    found = {(r["window"], r["buckets"]) for r in runs.select("window", "buckets").distinct().limit(2).collect()}
    if len(found) > 1 or any(w != window for w, _ in found):
        raise ValueError(f"runs of (window, buckets) {sorted(found)} don't go with a window of {window} and each other; build them with one setting")
    return next(iter(found))[1] if found else BUCKETS


def _repeated_anchors(named: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, a): the sorted anchors that the table holds twice or more; texts are not shuffled for it."""
    gram = min(GRAM, window)

    def send(batches):
        for b in slices(batches):
            keys, twice = once(_Texts(pa.table([b.column(0), b.column(1), b.column(2)], names=["id", "text", "tie"]), window, gram).anchors()[1])
            order, parts = dealt(keys, buckets)
            yield from messages([(0, k, 0, keys[order[x:y]], twice[order[x:y]], None) for k, x, y in parts]).to_batches()

    def meet(table):
        u, at = np.unique(np.concatenate(arrays(table, "a", np.uint64)), return_inverse=True)
        n = np.bincount(at, 1 + np.concatenate(arrays(table, "b", np.bool_)))
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([u[n > 1].tobytes()], pa.binary())], names=["bucket", "a"])

    return group_messages(named.select("id", "text", "tie").mapInArrow(send, MESSAGE), "bucket", meet, "bucket int, a binary")


def _judged(part: DataFrame, window: int, n: int, buckets: int, with_text: bool, n_carry: int, runs: DataFrame, alive: DataFrame | None) -> DataFrame:
    """A batch's documents, in n blocks, judged (run is null), and its run (bucket, run; the rest null). alive: anchors that repeat anywhere; None: all windows are asked for."""
    gram, every = min(GRAM, window), alive is None
    base = part.withColumn("block", F.pmod(F.xxhash64("id", "tie"), F.lit(n)).cast("int"))

    def send_anchors(table):
        t = _Texts(table, window, gram)
        keys, _ = once(t.anchors()[1])
        order, parts = dealt(keys, buckets)
        return messages([(table.column("block")[0].as_py(), k, 0, keys[order[x:y]], None, None) for k, x, y in parts])

    def answer_anchors(table, held):
        keys = np.concatenate([np.zeros(0, np.uint64), *arrays(held, "a", np.uint64)])
        rows = []
        for block, bucket, mine in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), arrays(table, "a", np.uint64), strict=True):
            mine = mine[np.isin(mine, keys, assume_unique=True)]
            if len(mine):
                rows.append((block, bucket, 0, mine, None, None))
        return messages(rows)

    def send_windows(table, replies):
        if not len(table):
            return messages([])
        t, block = _Texts(table, window, gram), table.column("block")[0].as_py()
        at = t.windows(None if every else np.sort(concat(arrays(replies, "a", np.uint64), np.uint64)))
        if not len(at):
            return messages([])
        finger = t.fingerprints(at)
        # the block's first place of a window is asked for; its others have come before whatever the answer
        first = _first(finger["k"], finger["c"])
        begin, end = _runs(at[~first])
        at, finger = at[first], finger[first]
        order, parts = dealt(finger["k"], buckets)
        at, finger = at[order], finger[order]
        doc, rows = t.doc[at], []
        for k, x, y in parts:
            docs, counts = np.unique(doc[x:y], return_counts=True)
            rows.append((block, k, 1, finger[x:y], t.ids[docs], counts.astype(np.uint32)))
        # to itself: the windows that were sent, by bucket, and stretches of those that were not
        rows.append((block, block, 2, at.astype(np.uint32), np.array([[k, x, y] for k, x, y in parts], np.uint32), np.stack([begin, end]).astype(np.uint32)))
        return messages(rows)

    def judge(table, held):
        kinds, rows = table.column("kind").to_pylist(), []
        blocks = table.column("block").to_pylist()
        a, b, c = (table.column(x) for x in "abc")
        sent = [k for k, x in enumerate(kinds) if x == 1]
        if sent:
            bucket = next(table.column("bucket")[k].as_py() for k in sent)
            packed = [np.frombuffer(a[k].as_buffer(), dtype=_FINGER) for k in sent]
            docs = np.concatenate([np.repeat(np.frombuffer(b[k].as_buffer(), _DOC), np.frombuffer(c[k].as_buffer(), np.uint32)) for k in sent])
            flat = np.concatenate(packed)
            # by document; a document's windows lie in one block, in order of place
            order = np.lexsort((docs["tie"], docs["id"]))
            repeat = np.zeros(len(flat), bool)
            repeat[order], new = seen_before(flat[order], arrays(held, "a", _FINGER))
            cut = np.concatenate([[0], np.cumsum([len(p) for p in packed])])
            rows += [(blocks[k], bucket, 1, np.packbits(repeat[x:y]), None, None) for k, x, y in zip(sent, cut, cut[1:])]
            rows.append((-1 - bucket, bucket, 3, new, None, None))
        rows += [(blocks[k], 0, 2, a[k].as_buffer(), b[k].as_buffer(), c[k].as_buffer()) for k, x in enumerate(kinds) if x == 2]
        return messages(rows)

    def cut_out(table, replies):
        kinds = replies.column("kind").to_pylist()
        if not len(table):  # a bucket's run has a block of its own
            runs_ = [k for k, x in enumerate(kinds) if x == 3]
            none = [pa.nulls(len(runs_), f.type) for f in out][:-2]
            return pa.table([*none, pa.array([replies.column("bucket")[k].as_py() for k in runs_], pa.int32()), pa.array([replies.column("a")[k].as_py() for k in runs_], pa.binary())], schema=out)
        t = _Texts(table, window, gram)
        covered = np.zeros(len(t.hash) + 1, np.int32)
        bits = {replies.column("bucket")[k].as_py(): np.frombuffer(replies.column("a")[k].as_buffer(), np.uint8) for k, x in enumerate(kinds) if x == 1}
        for k in (k for k, x in enumerate(kinds) if x == 2):
            at, parts, again = (np.frombuffer(replies.column(x)[k].as_buffer(), np.uint32).astype(np.int64) for x in "abc")
            for bucket, x, y in parts.reshape(-1, 3):
                if bucket in bits:
                    hit = at[x:y][np.unpackbits(bits[bucket], count=y - x).astype(bool)]
                    np.add.at(covered, hit, 1)
                    np.add.at(covered, hit + window, -1)
            begin, end = again.reshape(2, -1)
            np.add.at(covered, begin, 1)
            np.add.at(covered, end - 1 + window, -1)
        gone = np.cumsum(covered[:-1]) > 0
        words, removed, sha, texts = np.diff(t.first), [], [], []
        raw = t.data.tobytes()
        for d in range(len(t.ids)):
            x, y = t.first[d], t.first[d + 1]
            stay = np.flatnonzero(~gone[x:y]) + x
            joined = b" ".join([raw[i:j] for i, j in zip(t.start[stay].tolist(), t.end[stay].tolist(), strict=True)])
            removed.append(int(y - x - len(stay)))
            sha.append(hashlib.sha256(joined).hexdigest())
            texts.append(joined.decode("utf-8", "replace") if with_text else None)
        own = [table.column(c).take(pa.array(t.order)) for c in ("id", *(f"carry_{k}" for k in range(n_carry)))]
        none = [pa.nulls(len(t.ids), pa.int32()), pa.nulls(len(t.ids), pa.binary())]
        return pa.table([own[0], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(texts, pa.string()), *own[1:], *none], schema=out)

    carried = [part.schema[f"carry_{k}"] for k in range(n_carry)]
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), *[(f.name, to_arrow_type(f.dataType)) for f in carried], ("bucket", pa.int32()), ("run", pa.binary())])
    if alive is None:
        replies = part.limit(0).selectExpr("0 AS block", *_EMPTY)
    else:
        replies = answer_buckets(group_messages(base, "block", send_anchors), alive, answer_anchors)
    sent = answer(base, replies, send_windows)
    judged = answer_buckets(sent, runs, judge)
    return answer(base, judged, cut_out, "id bigint, n_words long, n_removed long, kept_sha256 string, kept string" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in carried) + ", bucket int, run binary")


_EMPTY = ["0 AS bucket", "0 AS kind", "cast(null as binary) AS a", "cast(null as binary) AS b", "cast(null as binary) AS c"]
#: Buckets of an index, where no table's size tells.
BUCKETS = 1024


def index_of(df: DataFrame, window: int = 20, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Runs of all of a table's windows, rows RUN to keep and to give to ``deduplicate`` as history.

    A bucket's windows of this table make one run of level 0. Append the rows
    to those of earlier tables; ``compact`` merges those of one level. Window
    and number of buckets are kept with the runs and must agree.
    """
    base, _ = blocked(df, id_col, text)
    base = base.withColumn("id", F.lit(None).cast("bigint")).withColumn("tie", F.lit(0).cast("bigint"))

    def send(table):
        t = _Texts(table, window, min(GRAM, window))
        finger = merged([t.fingerprints(t.windows(None))])
        order, parts = dealt(finger["k"], buckets)
        return messages([(0, k, 3, finger[order[x:y]], None, None) for k, x, y in parts])

    def run(table):
        return pa.table([pa.array([x], pa.int32()) for x in (table.column("bucket")[0].as_py(), 0, window, buckets)] + [pa.array([merged(arrays(table, "a", _FINGER)).tobytes()], pa.binary())], names=["bucket", "level", "window", "buckets", "a"])

    return group_messages(group_messages(base, "block", send), "bucket", run, RUN)


def compact(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """Runs of a bucket and level, if there are ``fan`` or more, become one of the next level; fewer stay as they are."""

    def merge(table):
        if len(table) < fan:
            return table
        first = table.slice(0, 1).to_pylist()[0]
        return pa.table([pa.array([x], pa.int32()) for x in (first["bucket"], first["level"] + 1, first["window"], first["buckets"])] + [pa.array([merged(arrays(table, "a", _FINGER)).tobytes()], pa.binary())], names=table.schema.names)

    return runs.select("bucket", "level", "window", "buckets", "a").groupBy("bucket", "level").applyInArrow(merge, RUN)


_FINGER = np.dtype([("k", "<u8"), ("c", "<u8")])
_DOC = np.dtype([("id", "<i8"), ("tie", "<i8")])
