"""SentencePiece encoding and decoding by N-best segmentation.

A text's lattice has an edge for each vocabulary piece that matches. Forward
Viterbi scores give the best way to every position; taken as heuristic they are
exact, so a backward A-star search from the end pops complete segmentations in
order of score. No piece crosses from a word into the next mark of space, so
the lattice falls into segments: their forward and backward scores are computed
for many segments at once, and the search runs where alternatives are near.

Ties: the longer last piece first, then the earlier place in the text.

A unigram vocabulary's scores are log probabilities and are taken as they are.
A merge vocabulary's are whole numbers, the order of its merges; a sum of those
means nothing, so a piece's order is taken as its rank in Zipf's law and scores
minus its logarithm. What is found is the best sum of such scores; a merge
vocabulary's own encoder joins letters greedily by order and often cuts
elsewhere.
"""

import gc
import heapq
import math
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_P = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20  # bits of a slot of the piece table
_LONG = 48  # segments of more characters are searched one by one
MEMO = 300_000


class PieceModel:
    """Pieces and scores of a vocabulary file, with byte pieces for what it lacks."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.piece_bytes: list[bytes] = []
        self.pieces: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        scores = np.zeros(n + 1)
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.piece_bytes.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.piece_bytes.append(b"")
            else:
                self.pieces[p] = i
                scores[i] = m.get_score(i)
                self.piece_bytes.append(p.encode().replace(SPACE.encode(), b" "))
        given = list(self.pieces.values())
        if (scores[given] == np.round(scores[given])).all():
            scores[given] = -np.log(2 + scores[given].max() - scores[given])
        self.unknown = float(min(scores[given])) - UNKNOWN_PENALTY
        scores[n] = -math.inf
        self.scores, self.none = scores, n
        self.longest = max(map(len, self.pieces))
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece holds a space after other letters; segments would not be independent")
        apart = [c for c in "\n\r\t" if not any(c in p for p in self.pieces if len(p) > 1)]
        alone = "".join(map(re.escape, apart))
        self.split = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")).findall
        self._tables()

    def _tables(self):
        names, ids = list(self.pieces), np.array(list(self.pieces.values()))
        h = np.array([self._hash(p) for p in names], dtype=np.uint64)
        self.hashes = np.zeros(self.none + 1, dtype=np.uint64)
        self.hashes[ids] = h
        if len(set(h.tolist())) != len(h):
            raise ValueError("two pieces have one hash")
        self.first = np.full(1 << _SLOTS, self.none, dtype=np.int32)
        at = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.first[at] = ids
        rest = self.first[at] != ids
        self.second = np.full(1 << _SLOTS, self.none, dtype=np.int32)
        at2 = ((h[rest] * _P) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.second[at2] = ids[rest]
        self.third = {int(h[rest][k]): int(ids[rest][k]) for k in np.flatnonzero(self.second[at2] != ids[rest])}

    @staticmethod
    def _mix(h):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def _hash(self, piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _P + np.uint64(ord(c) + 1)
        return int(self._mix(h)[0])

    def _find(self, h):
        """Piece ids of hashes; ``none`` where there is no piece."""
        a = self.first[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        hit = self.hashes[a] == h
        b = self.second[((h * _P) >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        a = np.where(hit & (a != self.none), a, np.where((self.hashes[b] == h) & (b != self.none), b, self.none))
        for k, i in self.third.items():
            a[h == np.uint64(k)] = i
        return a

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _ids(self, segment: str, cuts: list[tuple[int, int, int]]) -> tuple[int, ...]:
        """Ids of (start, end, piece) edges in order; bytes for edges without a piece."""
        out = []
        for a, b, i in cuts:
            out += [i] if i != self.none else [self.byte_ids[x] for x in segment[a:b].encode("utf-8", "surrogatepass")]
        return tuple(out)

    def forward(self, segment: str) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """Best score to each position, and the edges (start, piece, score) that end there."""
        best, edges = [0.0] + [-math.inf] * len(segment), [[] for _ in range(len(segment) + 1)]
        for j in range(1, len(segment) + 1):
            for i in range(max(0, j - self.longest), j):
                k = self.pieces.get(segment[i:j])
                if k is not None:
                    edges[j].append((i, k, float(self.scores[k])))
                elif i == j - 1:
                    edges[j].append((i, self.none, self.unknown))
            best[j] = max(best[i] + s for i, _, s in edges[j])
        return best, edges

    def nbest(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids): A-star from the end with the forward scores as heuristic."""
        if not segment:
            return [(0.0, ())]
        best, edges = self.forward(segment)
        # by score, then longer pieces from the end; the path is a chain of edges
        heap = [(-best[-1], (), len(segment), 0.0, None)]
        out = []
        while heap and len(out) < n:
            _, order, at, done, path = heapq.heappop(heap)
            if at == 0:
                cuts, p = [], path
                while p:
                    cuts.append(p[0])
                    p = p[1]
                out.append((done, self._ids(segment, cuts)))
                continue
            for i, k, s in edges[at]:
                heapq.heappush(heap, (-(best[i] + s + done), (*order, i - at), i, done + s, ((i, at, k), path)))
        return out

    def solve(self, segments: list[str]) -> list[tuple[float, float, tuple[int, ...]]]:
        """Per segment: best score, loss of the second best, best ids; many segments of a length at once."""
        out: list = [None] * len(segments)
        by: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by.setdefault(len(s), []).append(k)
        for size, which in by.items():
            if size > _LONG:
                for k in which:
                    two = self.nbest(segments[k], 2)
                    out[k] = (two[0][0], two[0][0] - two[1][0] if len(two) > 1 else math.inf, two[0][1])
                continue
            for at in range(0, len(which), 8192):
                part = which[at : at + 8192]
                for k, x in zip(part, self._solve([segments[k] for k in part], size), strict=True):
                    out[k] = x
        return out

    def _solve(self, segs, size):
        n, most = len(segs), min(size, self.longest)
        c = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).astype(np.uint64) + np.uint64(1)
        piece, score, h = [], [], np.zeros((n, size), np.uint64)
        for w in range(1, most + 1):
            h = h[:, : size - w + 1] * _P + c[:, w - 1 :]
            p = self._find(self._mix(h))
            s = self.scores[p]
            if w == 1:
                s[p == self.none] = self.unknown
            piece.append(p)
            score.append(s)
        fore, back, step = np.full((n, size + 1), -np.inf), np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
        fore[:, 0] = back[:, size] = 0
        for j in range(1, size + 1):
            for w in range(min(j, most), 0, -1):
                v = fore[:, j - w] + score[w - 1][:, j - w]
                up = v > fore[:, j]
                fore[up, j] = v[up]
                step[up, j] = w
        for i in range(size - 1, -1, -1):
            for w in range(1, min(size - i, most) + 1):
                np.maximum(back[:, i], score[w - 1][:, i] + back[:, i + w], out=back[:, i])
        on = [np.zeros((n, size - w + 1), bool) for w in range(1, most + 1)]
        place, rows, taken = np.full(n, size), np.arange(n), []
        while len(rows):
            w = step[rows, place[rows]]
            start = place[rows] - w
            got = np.empty(len(rows), np.int64)
            for x in np.flatnonzero(np.bincount(w)):
                of = w == x
                r, a = rows[of], start[of]
                on[x - 1][r, a] = True
                got[of] = piece[x - 1][r, a]
            taken.append((rows, start, np.where(got == self.none, -1 - start, got)))
            place[rows] = start
            rows = rows[start > 0]
        row, start, ids = (np.concatenate(x) for x in zip(*taken, strict=True))
        ids = ids[np.argsort(row * (size + 1) + start, kind="stable")]
        cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).tolist()
        odd = set(row[np.isin(row, row[np.concatenate([x[2] for x in taken]) < 0])].tolist())
        ids = ids.tolist()
        second = np.full(n, -np.inf)
        for w in range(1, most + 1):
            v = fore[:, : size - w + 1] + score[w - 1] + back[:, w:]
            v[on[w - 1]] = -np.inf
            np.maximum(second, v.max(1), out=second)
        best = fore[:, size]
        out = [tuple(ids[x:y]) for x, y in zip(cut, cut[1:])]
        for k in odd:
            out[k] = tuple(chain.from_iterable([p] if p >= 0 else [self.byte_ids[x] for x in segs[k][-1 - p].encode("utf-8", "surrogatepass")] for p in out[k]))
        return list(zip(best.tolist(), (best - second).tolist(), out, strict=True))

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined, marks of space turned back, the first one dropped."""
        raw = b"".join(map(self.piece_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _nbest_arrays(m: PieceModel, texts: list[str | None], n: int, memo: dict) -> list[list[tuple[float, np.ndarray]]]:
    """For each text its n best (score, ids), best first; null is empty.

    memo: places of segments solved so far, under None what is known of them
    (score, loss of the second best, number of ids, first id's place, ids on
    end), under (segment, n) the ways to cut it.
    """
    if len(memo) > MEMO:
        memo.clear()
    split = [m.split(m.normalise(t or "")) for t in texts]
    new = list(set(chain.from_iterable(split)).difference(memo))
    score, loss, size, begin, flat = memo.get(None) or (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    if new:
        s, d, ids = zip(*m.solve(new), strict=True)
        own = np.fromiter(map(len, ids), np.int64, len(ids))
        memo.update(zip(new, range(len(score), len(score) + len(new)), strict=True))
        begin = np.concatenate([begin, len(flat) + np.cumsum(own) - own])
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.int32, int(own.sum()))])
        score, loss, size = np.concatenate([score, s]), np.concatenate([loss, d]), np.concatenate([size, own])
        memo[None] = score, loss, size, begin, flat
    out = []
    for segs in split:
        at = np.fromiter(map(memo.__getitem__, segs), np.int64, len(segs))
        total, lost_at, held = sum(score[at].tolist()), loss[at], size[at]
        first = np.cumsum(held) - held
        base = flat[np.repeat(begin[at] - first, held) + np.arange(held.sum())]
        places = [int(k) for k in np.argsort(lost_at, kind="stable")[: n - 1] if math.isfinite(lost_at[k])] if n > 1 else []
        ways = {}
        for k in places:
            if (segs[k], n) not in memo:
                memo[segs[k], n] = m.nbest(segs[k], n)
            ways[k] = memo[segs[k], n]
        heap, seen, found = [(0.0, (0,) * len(places))], {(0,) * len(places)}, []
        while heap and len(found) < n:
            lost, pick = heapq.heappop(heap)
            full = base
            for k, p in sorted(zip(places, pick, strict=True), reverse=True):
                if p:
                    full = np.concatenate([full[: first[k]], np.array(ways[k][p][1], np.int32), full[first[k] + held[k] :]])
            found.append((total - lost, full))
            for d, k in enumerate(places):
                nxt = (*pick[:d], pick[d] + 1, *pick[d + 1 :])
                if nxt[d] < len(ways[k]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (sum(ways[q][0][0] - ways[q][p][0] for q, p in zip(places, nxt, strict=True)), nxt))
        out.append(found)
    return out


def encode_nbest(m: PieceModel, texts: list[str | None], n: int, memo: dict) -> list[list[tuple[float, list[int]]]]:
    """For each text its n best (score, ids), best first; null is empty."""
    return [[(s, ids.tolist()) for s, ids in found] for found in _nbest_arrays(m, texts, n, memo)]


def encode_documents(df: DataFrame, path: str, n: int = 3, id_col: str = "doc_id", text: str = "text", with_ids: bool = False, batch_bytes: int = 4 << 20) -> DataFrame:
    """Each text's n best segmentations, and whether the best decodes to the text again.

    Columns: id_col, n_pieces, ids_crc32 (of the best ids, little-endian),
    nbest_scores and nbest_crc32 (best first; fewer if the lattice has fewer),
    decoded_ok; with ``with_ids`` also ids. Null or empty text: no pieces, one
    segmentation of score 0. Texts are taken whole, about ``batch_bytes`` at a
    time. A text that itself holds the mark of space decodes to a space there.
    Equal texts give equal rows, repeated rows each their own; other columns are
    not read. Empty table: no rows.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_pieces long, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, decoded_ok boolean" + ", ids array<int>" * with_ids

    def groups(column):
        held, size, begin = [], 0, 0
        for k, t in enumerate(column):
            held.append(t.as_py())
            size += len(held[-1] or "")
            if size >= batch_bytes:
                yield begin, held
                held, size, begin = [], 0, k + 1
        if held:
            yield begin, held

    def run(batches):
        gc.disable()  # many small tuples and no cycles
        m, memo = model(path), {}
        for b in batches:
            for begin, texts in groups(b.column(1)):
                rows = []
                for t, found in zip(texts, _nbest_arrays(m, texts, n, memo), strict=True):
                    best = found[0][1].tolist()
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found]
                    rows.append((len(best), crc[0], [s for s, _ in found], crc, m.decode(best) == (t or "").replace(SPACE, " "), *([best] if with_ids else [])))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(texts)), *[pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds)]], names=[id_col, "n_pieces", "ids_crc32", "nbest_scores", "nbest_crc32", "decoded_ok", *["ids"] * with_ids])

    return df.select(id_col, text).mapInArrow(run, schema)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids", text: str = "text") -> DataFrame:
    """The texts of lists of ids (null: null; empty: empty). An id that the vocabulary lacks is an error. Empty table: no rows."""

    def run(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, text])

    return df.select(id_col, ids).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{text}` string")
