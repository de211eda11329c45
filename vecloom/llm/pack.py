"""Packing: shortest-pack-first over the length histogram.

Only the histogram of piece lengths, at most ``size`` numbers, comes to the
driver. Lengths are placed longest first, always into the packs with most
room, by updating counts of packing patterns; the patterns then meet the
pieces by rank within their length.
"""

import heapq
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import settle, with_rank
from vecloom.llm.tokens import encode


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many packs, their lengths in order) that hold ``counts[length]`` pieces of each length."""
    open_: dict[int, list] = {}  # room -> [[packs, lengths]]
    rooms: list[int] = []  # a heap of rooms, widest first
    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens does not fit {size}")
        left, made = counts[length], []
        while left > 0:
            while rooms and not open_.get(-rooms[0]):
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room >= length:
                group = open_[room][-1]
                n = min(left, group[0])
                made.append((room - length, n, (*group[1], length)))
                if n == group[0]:
                    open_[room].pop()
                else:
                    group[0] -= n
                left -= n
            else:
                # new packs hold as many of this length as fit
                k = size // length
                n, k = (left // k, k) if left >= k else (1, left)
                made.append((size - length * k, n, (length,) * k))
                left -= n * k
            # a pack that still is the widest takes another piece of this length
            r, n, lengths = made.pop()
            if r not in open_ or not open_[r]:
                heapq.heappush(rooms, -r)
            same = next((g for g in open_.setdefault(r, []) if g[1] == lengths), None)
            if same:
                same[0] += n
            else:
                open_[r].append([n, lengths])
    return [(n, lengths) for room in sorted(open_) for n, lengths in open_[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a length go, by rank: (length, first rank, end rank, first sequence, offset, pieces on end in each sequence).

    Equal lengths on end are one entry, so a pattern has at most 63 for 2,048
    tokens (63 different lengths add up to 2,016), and each length adds at most
    two patterns: a few MB at most, whatever the table's size.
    """
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for n, lengths in patterns:
        at = 0
        for x, same in itertools.groupby(lengths):
            each, first = len(list(same)), taken.get(x, 0)
            out.append((x, first, first + n * each, sequence, at, each))
            taken[x] = first + n * each
            at += x * each
        sequence += n
    return out


def pieces_of(df: DataFrame, json_path: str, ranks_path: str | None, pattern: str | None, size: int, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece of at most ``size`` ids: id_col, start, length, ids_crc32, doc_tokens. Null text: the end id alone."""
    id_type = df.schema[id_col].dataType.simpleString()
    out = f"{id_col} {id_type}, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                rows, which = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(t or "", json_path, ranks_path, pattern), end_id], dtype="<u4")
                    for s in range(0, len(ids), size):
                        which.append(i)
                        rows.append((s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size].tobytes()), len(ids)))
                cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), *cols], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(id_col, text).mapInArrow(run, out)


def pack_documents(df: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document's ids (and the end id) into sequences of at most ``size``.

    A document is cut every ``size`` ids; full pieces fill a sequence each.
    Returns a row per piece: id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. The pieces are settled once (a few dozen bytes each);
    texts are read and tokenized in one pass. Where pieces go is broadcast, which
    ``slots`` bounds. Columns that clash with these are not read. Null or empty text: one piece of
    one id. Empty table: no rows. Repeated rows are packed each.
    """
    spark = df.sparkSession
    pieces = settle(pieces_of(df, json_path, ranks_path, pattern, size, end_id, id_col, text))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(pack_histogram(counts, size))
    n = sum(counts.values())
    buckets = min(1 << 16, max(256, n // 4096))
    h = F.xxhash64(F.col(id_col), "start")
    dealt = pieces.withColumn("__h", h).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    ranked = with_rank(dealt, ["length"], "__b", ["__h", F.col(id_col), "start", "ids_crc32"], "__rank")
    where = F.broadcast(spark.createDataFrame(places or [(0, 0, 0, 0, 0, 1)], "__length long, __lo long, __hi long, __seq long, __off long, __each long"))
    out = ranked.join(where, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    at = F.col("__rank") - F.col("__lo")
    sequence, offset = F.col("__seq") + F.expr("(__rank - __lo) div __each"), F.col("__off") + at % F.col("__each") * F.col("length")
    return out.select(id_col, "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"))
