"""Suffix-array deduplication of long byte strings.

Which strings of ``length`` bytes start in two places is decided by sorting
suffixes, one bucket at a time:

1. Anchors (the smallest 32-byte hash of a window, the same ones in equal
   strings) and what stands beside them cut the suffixes into buckets: a string
   holds its anchor with 84 bytes to the left of it, or to the right, so only
   contexts that agree on those meet. Sides that occur once are left out, and
   equal whole texts are kept once.
2. A bucket holds its anchors' contexts, laid out on a grid whose columns are
   distances to the anchor, so equal strings lie in equal columns.
3. In it, ranks of 16, 32, 64, 128 and 192 bytes are precomputed by doubling at
   the columns of a difference cover modulo 16. From any column at most seven
   bytes lead to a covered one; a suffix is then sorted by the rank there and
   the eight bytes that are left over on both sides, so long ties cost no long
   comparisons. As columns are aligned, of the cover's property only that its
   gaps are short is needed.
4. Memory is bounded by the contexts of one side, at most HOT: the strings of a
   side that more places share are dealt one by one, by a 128-bit hash, and a
   block sends each once, so no passage is hot.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.blocks import anchors, answer, blocked, bucket_of, dealt, group_messages, messages, repeated_keys, spans_of
from vecloom.llm.common import BASE, BYTE_HASH, flat_bytes, inverse, mix, powers, whole_numbers

GRAM = 32
#: A difference cover modulo 16: every distance is one of two of its residues; no gap is over 8.
COVER, PERIOD = (0, 1, 2, 5, 8), 16
LENGTH = 200
_LEFT = LENGTH - GRAM  # columns before the anchor
_HALF = (LENGTH + GRAM) // 2  # a string holds so many bytes from its anchor to the right, or to the left of the anchor's end
_SIDE = _HALF - GRAM
#: The anchor's column and the columns of a grid: strings with the left side begin at columns 0 to _SIDE, those with the right side after these.
_GRIDS = ((_LEFT, _SIDE + LENGTH), (_LEFT - _SIDE - 1, _LEFT - _SIDE - 1 + LENGTH))
#: Contexts of a side; more places make it hot. A chunk holds whole sides.
HOT = _CHUNK = 4096
_TABLE2 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASE2 = np.uint64(0x2545F4914F6CDD1D)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIR = np.dtype([("x", "<u8"), ("y", "<u8")])


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def repeated_windows(grid: np.ndarray, lo: np.ndarray, hi: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows x first columns: whether the LENGTH bytes from there are in another row too (or the row itself is there twice).

    grid: contexts by their distance to the anchor; lo and hi: the columns that
    a row fills. many: rows that are there twice.
    """
    rows, width = grid.shape
    covered = [q for q in range(width - PERIOD + 1) if q % PERIOD in COVER]
    word = lambda q: np.ascontiguousarray(grid[:, q : q + 8]).view(">u8")[:, 0].astype(np.uint64)
    pair = lambda a, b: _ranks(a.astype(np.int64) * (rows + 1) + b)
    rank = {16: {q: pair(_ranks(word(q)), _ranks(word(q + 8))) for q in covered}}
    for size in (32, 64, 128):
        half = size // 2
        rank[size] = {q: pair(r, rank[half][q + half]) for q, r in rank[half].items() if q + half in rank[half]}
    starts = np.arange(width - LENGTH + 1)
    last = {q: pair(r, rank[64][q + 128]) for q, r in rank[128].items() if q + 128 in rank[64] and q <= starts[-1] + 7}
    fits = (lo[:, None] <= starts) & (hi[:, None] >= starts + LENGTH)
    out = fits & many[:, None]
    for c in starts.tolist():
        d = next(d for d in range(8) if (c + d) % PERIOD in COVER)
        valid = np.flatnonzero(fits[:, c])
        if not len(valid):
            continue
        r = last[c + d][valid]
        valid = valid[np.bincount(r)[r] > 1]
        if not len(valid):
            continue
        rest = np.concatenate([grid[valid, c : c + d], grid[valid, c + d + 192 : c + LENGTH]], axis=1)
        rest = np.ascontiguousarray(rest).view(">u8")[:, 0]
        r = last[c + d][valid]
        order = np.lexsort((rest, r))
        same = (r[order][1:] == r[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        hit = np.zeros(len(order), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[valid[order[hit]], c] = True
    return out


def unique_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different 128-bit keys in order, where each key is among them, and how often each is there."""
    order = np.lexsort((keys["y"], keys["x"]))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k["x"][1:] != k["x"][:-1]) | (k["y"][1:] != k["y"][:-1])
    at = np.zeros(len(k), np.int64)
    at[order] = np.cumsum(new) - 1
    return k[new], at, np.bincount(at, minlength=int(new.sum()))


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows by id and text.

    Places in a block are kept from one round to the next, and a shuffle brings
    its rows in another order each time; rows that are alike in both are equal.
    """
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")]))


class _Texts:
    """A block's texts as bytes, with anchors and the hashes of what surrounds them."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.data, self.off = flat_bytes(table.column("text")) if len(table) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))

    def document_keys(self):
        """128-bit keys of texts that are long enough, and their rows."""
        size = np.diff(self.off)
        rows = np.flatnonzero(size >= LENGTH)
        raw = self.data.tobytes()
        digest = b"".join(hashlib.blake2b(raw[self.off[k] : self.off[k + 1]], digest_size=16).digest() for k in rows.tolist())
        return np.frombuffer(digest, dtype=_PAIR), rows

    def anchors(self, step: int = 1 << 20):
        """Per anchor: position, row, and keys of its left and right side (0: the text is too short there)."""
        out, at = [], 0
        while at < len(self.off) - 1:
            to = max(at + 1, int(np.searchsorted(self.off, self.off[at] + step, side="right")) - 1)
            out.append(self._anchors(at, to))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2

    def strings(self, at: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """128-bit hashes of the LENGTH bytes at ascending positions, about ``step`` bytes of whole texts at a time."""
        out, row = np.zeros(len(at), _PAIR), 0
        while row < len(self.off) - 1:
            to = max(row + 1, int(np.searchsorted(self.off, self.off[row] + step, side="right")) - 1)
            x, y = np.searchsorted(at, [self.off[row], self.off[to]])
            if y > x:
                data = self.data[self.off[row] : self.off[to]]
                p, n = at[x:y] - self.off[row], len(data)
                for name, table, base in (("x", BYTE_HASH, BASE), ("y", _TABLE2, _BASE2)):
                    acc = np.zeros(n + 1, np.uint64)
                    np.cumsum(table[data] * powers(n, base), out=acc[1:])
                    out[name][x:y] = mix((acc[p + LENGTH] - acc[p]) * powers(n, inverse(base))[p])
            row = to
        return out

    def _anchors(self, at, to):
        off = self.off[at : to + 1] - self.off[at]
        data, n, size = self.data[self.off[at] : self.off[to]], int(off[-1]), np.diff(off)
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_HASH[data] * powers(n), out=acc[1:])
        inv = powers(n, inverse(BASE))
        h = np.full(n, _NONE)
        if n > GRAM:
            h[: n - GRAM] = mix((acc[GRAM:n] - acc[: n - GRAM]) * inv[: n - GRAM])
        if n >= GRAM:
            h[n - GRAM] = mix((acc[n : n + 1] - acc[n - GRAM : n - GRAM + 1]) * inv[n - GRAM : n - GRAM + 1])[0]
        # no gram reaches over a text's end, and short texts have none
        for k in range(1, GRAM):
            e = off[1:] - k
            h[e[(e >= 0) & (e >= off[:-1])]] = _NONE
        for k in np.flatnonzero((size < LENGTH) & (size > 0)):
            h[off[k] : off[k + 1]] = _NONE
        p = anchors(h, LENGTH - GRAM + 1)
        p = p[h[p] != _NONE]
        row = np.searchsorted(off, p, side="right") - 1
        begin, end = off[row], off[row + 1]
        back = p - (_HALF - GRAM)
        ok_l, ok_r = back >= begin, p + _HALF <= end
        a, b = np.where(ok_l, back, 0), np.where(ok_r, p + _HALF, 0)
        kl = np.where(ok_l, mix((acc[p + GRAM] - acc[a]) * inv[a] + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1), np.uint64(0))
        kr = np.where(ok_r, mix((acc[b] - acc[p]) * inv[p] + np.uint64(0x14057B7EF767814F)) | np.uint64(1), np.uint64(0))
        return p + self.off[at], row + at, kl, kr


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", kept: str | None = None, hot: int = HOT) -> DataFrame:
    """Remove every byte in a string of 200 bytes that also starts anywhere else, in the same text or another.

    Returns id_col, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``kept``, the bytes left (binary: a cut may fall inside a letter). Null
    text: empty. Shorter texts lose nothing; very long ones are taken whole.
    Repeated rows are occurrences of their own, so equal texts of 200 bytes or
    more vanish all. Strings are judged on the input; no order of rows matters.
    Ids must be whole numbers, may repeat and may be null. Other columns are
    not read. Empty table: no rows. ``hot``: places of a side beyond which its
    strings are dealt one by one; the result is the same for any number.
    """
    id_type = whole_numbers(df, id_col)
    base, n = blocked(df, id_col, text)

    def send_keys(table):
        t, block, rows = _Texts(table), table.column("block")[0].as_py(), []
        _, _, kl, kr = t.anchors()
        both = np.concatenate([kl, kr])
        keys, times = np.unique(both[both != 0], return_counts=True)
        order, parts = dealt(keys, n)
        rows += [(block, k, 0, keys[order][x:y], times[order][x:y].astype(np.uint32), None) for k, x, y in parts]
        keys, _, times = unique_pairs(t.document_keys()[0])
        order, parts = dealt(keys["x"].astype(np.uint64), n)
        rows += [(block, k, 1, keys[order][x:y], times[order][x:y].astype(np.uint32), None) for k, x, y in parts]
        return messages(rows)

    def send_contexts(table, replies):
        if not len(table):
            return messages([])
        table = in_order(table)
        t, block = _Texts(table), table.column("block")[0].as_py()
        kinds = replies.column("kind").to_pylist()
        get = lambda kind, col, dtype: np.concatenate([np.zeros(0, dtype)] + [np.frombuffer(replies.column(col)[k].as_buffer(), dtype) for k, x in enumerate(kinds) if x == kind])
        alive, crowded = get(0, "a", np.uint64), get(0, "c", np.bool_)
        alive, hot = np.sort(alive[~crowded]), np.sort(alive[crowded])
        # texts that are there twice go whole; the first one in the leading block still stands for the others
        docs, doc_rows = t.document_keys()
        twice, leads = get(1, "a", _PAIR), get(1, "b", np.bool_)
        state = dict(zip(twice.tolist(), leads.tolist(), strict=True))
        gone, silent, met = [], np.zeros(len(table), bool), set()
        for key, row in zip(docs.tolist(), doc_rows.tolist(), strict=True):
            if key in state:
                gone.append(row)
                silent[row] = not state[key] or key in met
                met.add(key)
        p, row, kl, kr = t.anchors()
        speaks = ~silent[row]
        before, after = p - t.off[row], t.off[row + 1] - p
        # contexts of both sides, each as far as its strings reach
        sides, edge = [], np.zeros(len(t.data) + 1, np.int32)
        for side, key in enumerate((kl, kr)):
            column, width = _GRIDS[side]
            left, right = np.minimum(before, column), np.minimum(after, width - column)
            live = speaks & (left + right >= LENGTH)
            ok = live & _among(key, alive)
            sides.append((key[ok], p[ok], left[ok], right[ok], np.full(int(ok.sum()), side)))
            ok = live & _among(key, hot)
            np.add.at(edge, (p - left)[ok], 1)
            np.add.at(edge, (p + right - LENGTH + 1)[ok], -1)
        key, p, left, right, side = (np.concatenate(x) for x in zip(*sides, strict=True))
        b = bucket_of(key, n)
        order = np.lexsort((key, b))
        key, p, left, right, side, b = key[order], p[order], left[order], right[order], side[order], b[order]
        cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(0, np.int64)
        raw, rows, sent = t.data.tobytes(), [], []
        for x, y in zip(cut, cut[1:]):
            index, which, many, keys = {}, [], [], []
            for f, q, lf, rt, sd in zip(key[x:y].tolist(), p[x:y].tolist(), left[x:y].tolist(), right[x:y].tolist(), side[x:y].tolist(), strict=True):
                c = (sd, lf, raw[q - lf : q + rt])
                k = index.setdefault(c, len(index))
                if k == len(many):
                    many.append(False)
                    keys.append(f)
                else:
                    many[k] = True
                which.append(k)
            head = np.zeros(len(index), _HEAD)
            head["s"], head["l"], head["r"], head["m"], head["k"] = [c[0] for c in index], [c[1] for c in index], [len(c[2]) - c[1] for c in index], many, keys
            rows.append((block, int(b[x]), 2, b"".join(c[2] for c in index), head, None))
            sent.append((int(b[x]), x, y, np.array(which, np.uint32)))
        which = np.concatenate([s[3] for s in sent]) if sent else np.zeros(0, np.uint32)
        rows.append((block, block, 3, np.stack([p.astype(np.uint32), which]) if len(p) else np.zeros((2, 0), np.uint32), np.array([s[:3] for s in sent], np.uint32), np.array(gone, np.uint32)))
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if len(at):
            found, where, times = unique_pairs(t.strings(at))
            order, parts = dealt(found["x"].astype(np.uint64), n)
            place = np.zeros(len(order), np.int64)
            place[order] = np.arange(len(order))
            rows += [(block, k, 4, found[order][x:y], times[order][x:y] > 1, None) for k, x, y in parts]
            rows.append((block, block, 5, at.astype(np.uint32), place[where].astype(np.uint32), np.array(parts, np.uint32)))
        return messages(rows)

    def judge(table):
        kinds, blocks, rows = table.column("kind").to_pylist(), table.column("block").to_pylist(), []
        col = {x: table.column(x) for x in "abc"}
        rows += [(blocks[k], 0, kinds[k], *(col[x][k].as_buffer() for x in "abc")) for k, x in enumerate(kinds) if x in (3, 5)]
        bucket = table.column("bucket")[0].as_py()
        one = [k for k, x in enumerate(kinds) if x == 4]
        if one:
            keys = [np.frombuffer(col["a"][k].as_buffer(), _PAIR) for k in one]
            _, at, times = unique_pairs(np.concatenate(keys))
            again = (times[at] > 1) | np.concatenate([np.frombuffer(col["b"][k].as_buffer(), np.bool_) for k in one])
            edge = np.cumsum([0, *map(len, keys)])
            rows += [(blocks[k], bucket, 4, np.packbits(again[x:y]), None, None) for k, x, y in zip(one, edge, edge[1:])]
        sent = [k for k, x in enumerate(kinds) if x == 2]
        if not sent:
            return messages(rows)
        heads = [np.frombuffer(col["b"][k].as_buffer(), dtype=_HEAD) for k in sent]
        head = np.concatenate(heads)
        left, right, many = head["l"].astype(np.int64), head["r"].astype(np.int64), head["m"].astype(bool)
        text = np.concatenate([np.frombuffer(col["a"][k].as_buffer(), np.uint8) for k in sent])
        begin = np.concatenate([[0], np.cumsum(left + right)[:-1]])
        found = []
        for side, (column, width) in enumerate(_GRIDS):
            # whole groups of one side, in chunks
            mine = np.flatnonzero(head["s"] == side)
            order = mine[np.argsort(head["k"][mine], kind="stable")]
            key = head["k"][order]
            group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
            x = 0
            while x < len(group) - 1:
                y = max(x + 1, int(np.searchsorted(group, group[x] + _CHUNK, side="right")) - 1)
                own = order[group[x] : group[y]]
                x = y
                grid = np.zeros((len(own), width), np.uint8)
                cols = np.arange(width)[None, :] - (column - left[own])[:, None]
                ok = (cols >= 0) & (cols < (left + right)[own][:, None])
                grid[ok] = text[(begin[own][:, None] + cols)[ok]]
                hits = repeated_windows(grid, column - left[own], column + right[own], many[own])
                for r in np.flatnonzero(hits.any(1)):
                    s, e = spans_of(hits[r])
                    found += [(own[r], a - column, z - 1 + LENGTH - column) for a, z in zip(s.tolist(), e.tolist(), strict=True)]
        if found:
            found = np.array(sorted(found), np.int64)
            edge = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
            for k, x, y in zip(sent, edge, edge[1:]):
                i, j = np.searchsorted(found[:, 0], [x, y])
                if j > i:
                    part = found[i:j].copy()
                    part[:, 0] -= x
                    rows.append((blocks[k], bucket, 2, part.astype(np.int32), None, None))
        return messages(rows)

    def cut_out(table, replies):
        if not len(table):
            return pa.table([[]] * 6, schema=_OUT)
        table = in_order(table)
        t = _Texts(table)
        edge = np.zeros(len(t.data) + 1, np.int32)
        kinds = replies.column("kind").to_pylist()
        spans = {replies.column("bucket")[k].as_py(): np.frombuffer(replies.column("a")[k].as_buffer(), np.int32).reshape(-1, 3) for k, x in enumerate(kinds) if x == 2}
        for k in (k for k, x in enumerate(kinds) if x == 3):
            p, which = np.frombuffer(replies.column("a")[k].as_buffer(), np.uint32).reshape(2, -1).astype(np.int64)
            for bucket, x, y in np.frombuffer(replies.column("b")[k].as_buffer(), np.uint32).reshape(-1, 3).astype(np.int64).tolist():
                if bucket not in spans:
                    continue
                s = spans[bucket]
                i, j = np.searchsorted(s[:, 0], which[x:y]), np.searchsorted(s[:, 0], which[x:y], side="right")
                n_hits = j - i
                at = np.repeat(p[x:y], n_hits)
                take = np.repeat(i - np.concatenate([[0], np.cumsum(n_hits)[:-1]]), n_hits) + np.arange(n_hits.sum())
                np.add.at(edge, at + s[take, 1], 1)
                np.add.at(edge, at + s[take, 2], -1)
            for r in np.frombuffer(replies.column("c")[k].as_buffer(), np.uint32).astype(np.int64):
                edge[t.off[r]] += 1
                edge[t.off[r + 1]] -= 1
        bits = {replies.column("bucket")[k].as_py(): np.frombuffer(replies.column("a")[k].as_buffer(), np.uint8) for k, x in enumerate(kinds) if x == 4}
        for k in (k for k, x in enumerate(kinds) if x == 5):
            at, place = (np.frombuffer(replies.column(x)[k].as_buffer(), np.uint32).astype(np.int64) for x in "ab")
            again = np.concatenate([np.unpackbits(bits[bucket], count=y - x) for bucket, x, y in np.frombuffer(replies.column("c")[k].as_buffer(), np.uint32).reshape(-1, 3).astype(np.int64).tolist()])
            at = at[again[place].astype(bool)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        removed, n_spans, sha, left = [], [], [], []
        for x, y in zip(t.off.tolist(), t.off[1:].tolist()):
            own = covered[x:y]
            rest = t.data[x:y][~own].tobytes()
            removed.append(y - x - len(rest))
            n_spans.append(len(spans_of(own)[0]) if len(rest) < y - x else 0)
            sha.append(hashlib.sha256(rest).hexdigest())
            left.append(rest if kept else None)
        return pa.table([table.column("id"), pa.array(np.diff(t.off)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(left, pa.binary())], schema=_OUT)

    base = base.withColumn("id", F.col("id").cast("bigint"))
    replies = group_messages(group_messages(base, "block", send_keys), "bucket", lambda table: repeated_keys(table, {1: _PAIR}, hot))
    judged = group_messages(answer(base, replies, send_contexts), "bucket", judge)
    result = answer(base, judged, cut_out, "id bigint, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result.select(F.col("id").cast(id_type).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *([F.col("kept").alias(kept)] if kept else []))


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


_HEAD = np.dtype([("k", "<u8"), ("s", "u1"), ("l", "u1"), ("r", "u1"), ("m", "u1")])


def _among(x: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted ones; 0 is none."""
    if not len(alive):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(alive, x), len(alive) - 1)
    return (alive[at] == x) & (x != 0)
