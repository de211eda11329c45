"""N-gram Jaccard join by signature trees.

A set of word shingles becomes a token bitmap. Nodes of a tree hold the OR of
the bitmaps below them and the range of set sizes; two trees are walked
together, and a pair of nodes is dropped when the overlap that its bitmaps and
sizes allow is under what the threshold asks. What is left at the leaves is
compared in full.

Trees are built over candidates only, split exactly: sets of Jaccard t or more
differ in few shingles, so of somewhat more parts (by shingle hash) of the two
sets, a known number are equal and not empty. Equal parts meet in hash buckets.
A linked pair shares half of that number in parts that few documents hold,
where pairs are counted, or half in parts that many hold, and then both
documents have that many such parts: passages that many documents share make
no candidates, and only a few of those documents are sent to the part's bucket from
each slice of the table. Of equal sets, found by a 128-bit hash, one stands for
all. Candidates form groups within one class of sizes, so that chains of
candidates do not run through all sizes; groups are dealt into chunks. A group of more than two chunks
is first compared as a star, each chunk with the first one, which costs a row or
two a document; only the sets that this doesn't join to the first chunk's own
largest component are then compared with all the others, so near copies of one
text cost no square of their number.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.blocks import group_messages
from vecloom.llm.common import components, deal, drop_settled, flat_bytes, grams, local_roots, mix, settle, slices, whole_numbers, with_whole, words_of

BITS = 2048
FAN = 8
#: Documents of a chunk; a group of candidates is compared in pairs of chunks.
CHUNK = 1024
#: A part that more documents hold is common.
COMMON = 8
#: Added to a class for the keys of sets with many empty parts.
_PREFIX = 128
#: Sizes of a class span this factor; a class shares its number of parts.
_SPAN = 0.73


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; a shorter text is one shingle, one without words has none."""
    data, off = flat_bytes(texts)
    h, _, _, first = words_of(data, off, lower=True)
    g = grams(h, n)
    out = []
    for x, y in zip(first.tolist(), first[1:].tolist()):
        if y - x >= n:
            out.append(np.unique(g[x : y - n + 1]))
        elif y > x:
            s = np.full(1, y - x, np.uint64)
            for k in range(x, y):
                s = mix(s * np.uint64(0xD1342543DE82EF95) + h[k : k + 1])
            out.append(s)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def size_class(n: int) -> int:
    return int(math.floor(math.log(n) / -math.log(_SPAN) + 1e-9))


def _class_bounds(c: int) -> tuple[int, int]:
    """Sizes lo <= n < hi of a class."""
    lo = max(1, math.ceil(_SPAN ** -c - 1e-6))
    while size_class(lo) < c:
        lo += 1
    hi = lo
    step = max(1, int(lo * (1 / _SPAN - 1)))
    hi = lo + step
    while size_class(hi) <= c:
        hi += 1
    while hi - 1 > lo and size_class(hi - 1) > c:
        hi -= 1
    return lo, hi


class Parts:
    """Keys of sets, their class in the last byte: sets of Jaccard num/den or more share ``half`` twice over.

    Such sets, the smaller of size a, differ in at most a x (den/num - 1)
    shingles, each of which spoils one part; the ``spare`` parts beyond are
    equal. A set with more than half of those empty also gives its smallest
    shingles: of as many as can differ and ``prefix`` more, any linked pair of
    such sets shares ``prefix``.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.known = num, den, {}

    def differ(self, n: int) -> int:
        return n * (self.den - self.num) // self.num

    def of_class(self, c: int) -> tuple[int, int]:
        """Parts spoilt at most, and parts."""
        if c not in self.known:
            most = self.differ(_class_bounds(c)[1] - 1)
            self.known[c] = most, most + 4 + most // 4
        return self.known[c]

    def prefix(self, c: int) -> int:
        """Smallest shingles beyond those that can differ: as many as parts are shared, if the smallest set of the class has them."""
        most, parts = self.of_class(c)
        return max(1, min(parts - most - (parts - most) // 2, _class_bounds(c)[0] - most))

    def half(self, c: int) -> int:
        """Half of the keys, rounded up, that linked sets share: parts, if at most half of the spare ones are empty, or smallest shingles."""
        if c >= _PREFIX:
            return -(-self.prefix(c - _PREFIX) // 2)
        most, parts = self.of_class(c)
        spare = parts - most
        return -(-(spare - spare // 2) // 2)

    def keys(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return np.zeros(0, np.uint64)
        c, out = size_class(n), []
        # as the smaller of a pair, in its own class; as the larger, in the classes of those it can meet
        for k in range(size_class(max(1, -(-n * self.num // self.den))), c + 1):
            most, parts = self.of_class(k)
            part = (mix(s) % np.uint64(parts)).astype(np.int64)
            total = np.zeros(parts, np.uint64)
            np.add.at(total, part, mix(s ^ np.uint64(0x2545F4914F6CDD1D)))
            full = np.flatnonzero(np.bincount(part, minlength=parts))
            out.append(mix(total[full] + full.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) & _HASH | np.uint64(k))
            if parts - len(full) > (parts - most) // 2:
                out.append(mix(s[: most + self.prefix(k)]) & _HASH | np.uint64(k + _PREFIX))
        return np.concatenate(out)


_HASH = np.uint64(0xFFFFFFFFFFFFFF00)


def _class_small(c: int) -> bool:
    """Whether sets of the class can exist: under 2^40 shingles."""
    return _SPAN ** -c < 1 << 40


_POP = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.int64)


def _count(bits: np.ndarray) -> np.ndarray:
    return _POP[bits.view(np.uint16)].reshape(*bits.shape[:-1], -1).sum(-1)


class SignatureTree:
    """Levels of nodes from the sets up to a root: OR of bitmaps, least and largest size, most tokens that share bits."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        # alike sets side by side, so that nodes stay sparse
        self.order = sorted(range(len(sets)), key=lambda k: (int(sets[k][0]) if len(sets[k]) else 0, len(sets[k])))
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        size = np.array([len(sets[k]) for k in self.order], np.int64)
        for row, k in enumerate(self.order):
            b = sets[k] % np.uint64(BITS)
            np.bitwise_or.at(bits[row], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        self.levels = [(bits, size, size, size - _count(bits))]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, slack = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at)))


def _may_link(a, i, b, j, num, den) -> np.ndarray:
    """Which pairs of nodes can hold linked sets, by sizes and by the most their bitmaps allow to be shared."""
    bits_a, lo_a, hi_a, slack_a = a
    bits_b, lo_b, hi_b, slack_b = b
    ok = (hi_a[i] * den >= lo_b[j] * num) & (hi_b[j] * den >= lo_a[i] * num)
    out = np.zeros(len(i), bool)
    at = np.flatnonzero(ok)
    for x in range(0, len(at), 4096):
        k = at[x : x + 4096]
        shared = _count(bits_a[i[k]] & bits_b[j[k]]) + np.minimum(slack_a[i[k]], slack_b[j[k]])
        # |A and B| >= num/den |A or B|  asks for  (num + den) |A and B| >= num (|A| + |B|)
        out[k] = shared * (num + den) >= num * (lo_a[i[k]] + lo_b[j[k]])
    return out


def candidate_pairs(a: SignatureTree, b: SignatureTree, num: int, den: int):
    """Pairs (index in a, index in b) of sets that the walk down both trees leaves, in stretches."""
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        keep = _may_link(a.levels[la], i, b.levels[lb], j, num, den)
        i, j = i[keep], j[keep]
        if a is b:
            i, j = i[i <= j], j[i <= j]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            yield i, j
            continue
        # down one level where the tree is higher; both if level
        da, db = la >= lb, lb >= la
        fa, fb = FAN if da else 1, FAN if db else 1
        i, j = np.repeat(i, fa * fb) * fa, np.repeat(j, fa * fb) * fb
        i += np.tile(np.repeat(np.arange(fa), fb), len(i) // (fa * fb))
        j += np.tile(np.arange(fb), len(j) // fb)
        inside = (i < len(a.levels[la - da][0])) & (j < len(b.levels[lb - db][0]))
        i, j = i[inside], j[inside]
        for x in range(0, len(i), 1 << 16):
            stack.append((la - da, lb - db, i[x : x + (1 << 16)], j[x : x + (1 << 16)]))


def linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both > 0 and den * both >= num * (len(s) + len(t) - both)


def spanning_links(a: SignatureTree, b: SignatureTree, num: int, den: int) -> list[tuple[int, int]]:
    """Linked pairs (index in a's sets, in b's) enough to connect all that links connect; pairs connected already are skipped."""
    n = len(a.sets)
    up = list(range(n + (0 if a is b else len(b.sets))))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in candidate_pairs(a, b, num, den):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = a.order[x], b.order[y]
            if a is b and x == y:
                continue
            r, s = root(x), root(y if a is b else y + n)
            if r != s and linked(a.sets[x], b.sets[y], num, den):
                up[max(r, s)] = min(r, s)
                out.append((x, y))
    return out


def all_links(a: SignatureTree, b: SignatureTree, num: int, den: int) -> list[tuple[int, int]]:
    """Every linked pair (index in a's sets, in b's)."""
    out = []
    for i, j in candidate_pairs(a, b, num, den):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = a.order[x], b.order[y]
            if (a is not b or x != y) and linked(a.sets[x], b.sets[y], num, den):
                out.append((x, y))
    return out


def jaccard_roots(df: DataFrame, shingle: int, num: int, den: int, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(node, root) of every document that links: the smallest id of its component. Ids must be whole numbers."""
    links, equal, settled = _links(df, shingle, num, den, id_col, text, chunk)
    found = components(links.unionByName(equal))
    for x in settled:
        drop_settled(x)
    return found


def jaccard_links(df: DataFrame, shingle: int, num: int, den: int, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(a, b), a < b: every pair of documents of Jaccard num/den or more, once each. Ids must be whole numbers.

    A pair links if any row of the one id does with any of the other. Every
    candidate pair is verified, copies too. A row per link by definition.
    """
    links, _, settled = _links(df, shingle, num, den, id_col, text, chunk, whole=True)
    out = settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for x in settled:
        drop_settled(x)
    return out


def _links(df, shingle, num, den, id_col, text, chunk, whole=False):
    """Links (a, b) enough to connect what links connect (``whole``: all), (copy, lead) of equal sets that one stands for (not if whole), and the settled tables that these read."""
    whole_numbers(df, id_col)
    named = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null")
    n, find = 2 * deal(df, text), all_links if whole else spanning_links

    def send_keys(batches):
        parts = Parts(num, den)
        for b in slices(batches):
            ids, sets = np.asarray(b.column(0)), shingle_sets(b.column(1), shingle)
            first, keys, owner, same, digests = {}, [], [], [], []
            for k, s in enumerate(sets):
                if len(s):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    lead = k if whole else first.setdefault(digest, k)
                    if lead != k:
                        same.append((ids[k], ids[lead]))
                    else:
                        x = parts.keys(s)
                        digests.append((digest, ids[k]))
                        keys.append(x)
                        owner.append(np.full(len(x), ids[k]))
            if not keys:
                continue
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            # more holders than make a key common need not meet in its bucket
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            other = new | np.concatenate([[True], owner[1:] != owner[:-1]])
            keys, owner, at = keys[other], owner[other], np.arange(int(other.sum()))
            place = at - np.maximum.accumulate(np.where(new[other], at, 0))
            beyond = place > COMMON
            spread = [(n + int(owner[beyond][0]) % n, keys[beyond].tobytes(), *_packed_ids(owner[beyond]))] if beyond.any() else []
            keys, owner = keys[~beyond], owner[~beyond]
            bucket = ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, owner, bucket = keys[order], owner[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows = [(int(bucket[x]), keys[x:y].tobytes(), *_packed_ids(owner[x:y])) for x, y in zip(cut, cut[1:])] + spread
            if same:
                rows.append((int(bucket[0]), None, np.array(same, np.int64).tobytes(), None))
            if not whole:
                held = np.zeros(len(digests), _SET)
                raw = np.frombuffer(b"".join(d for d, _ in digests), np.uint64).reshape(-1, 2)
                held["x"], held["y"], held["id"] = raw[:, 0], raw[:, 1], [d for _, d in digests]
                to = (held["x"] % np.uint64(n)).astype(np.int64)
                held, to = held[np.argsort(to, kind="stable")], np.sort(to)
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
                rows += [(int(to[x]), held[x:y].tobytes(), None, None) for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "ids", "at"])

    def meet(table):
        keys, ids, at = (table.column(c) for c in ("keys", "ids", "at"))
        k, o, same, held = [], [], [], [np.zeros(0, _SET)]
        for x in range(len(table)):
            if not ids[x].is_valid:
                held.append(np.frombuffer(keys[x].as_buffer(), _SET))
                continue
            i = np.frombuffer(ids[x].as_buffer(), np.int64)
            if keys[x].is_valid:
                k.append(np.frombuffer(keys[x].as_buffer(), np.uint64))
                o.append(i[np.frombuffer(at[x].as_buffer(), np.uint32)])
            else:
                same.append(i.reshape(-1, 2))
        # equal sets: the smallest id leads
        held = np.concatenate(held)
        held = held[np.lexsort((held["id"], held["y"], held["x"]))]
        new = np.ones(len(held), bool)
        new[1:] = (held["x"][1:] != held["x"][:-1]) | (held["y"][1:] != held["y"][:-1])
        lead = held["id"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(held) else held["id"]
        same.append(np.stack([held["id"], lead], 1)[held["id"] != lead])
        rows = [(1, *np.concatenate(same).T, 0, 1)]
        if k:
            k, o = np.concatenate(k), np.concatenate(o)
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            once = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
            k, o = k[once], o[once]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            held = np.repeat(np.diff(np.append(first, len(k))), np.diff(np.append(first, len(k))))
            if table.column("bucket")[0].as_py() >= n:  # held by more in one slice already
                held[:] = COMMON + 1
            few = np.flatnonzero(held <= COMMON)
            kf, of = k[few], o[few]
            pairs = [np.zeros((0, 3), np.int64)]
            for d in range(1, COMMON):
                i = np.flatnonzero(kf[d:] == kf[:-d])
                pairs.append(np.stack([of[i], of[i + d], (kf[i] & np.uint64(0xFF)).astype(np.int64)], 1))
            u, n_shared = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
            rows.append((0, *u.T, n_shared))
            many = np.flatnonzero(held > COMMON)
            rows.append((2, k[many].view(np.int64), o[many], (k[many] & np.uint64(0xFF)).astype(np.int64), 1))
        flat = [np.concatenate([np.broadcast_to(r[c], len(r[1])) for r in rows]) if rows else np.zeros(0, np.int64) for c in range(5)]
        return pa.table([pa.array(x.astype(np.int64)) for x in flat], names=["kind", "a", "b", "cls", "n"])

    met = settle(group_messages(named.mapInArrow(send_keys, "bucket int, keys binary, ids binary, at binary"), "bucket", meet, "kind long, a long, b long, cls long, n long"))
    parts = Parts(num, den)
    half = F.create_map(*[F.lit(x) for c in range(_PREFIX) for x in (c, parts.half(c) if _class_small(c) else 1 << 40)], *[F.lit(x) for c in range(_PREFIX) for x in (c + _PREFIX, parts.half(c + _PREFIX) if _class_small(c) else 1 << 40)])
    equal = met.where("kind = 1").select("a", "b")
    # a copy's links are its lead's; an id of several rows may have other texts too
    copies = equal.select(F.col("a").alias("gone")).distinct().join(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), F.col("gone") == F.col("id"), "left_anti")
    copies = copies if whole else settle(copies.select("gone"))
    alone = lambda df, c: df.join(copies, df[c] == copies["gone"], "left_anti")
    rare = met.where("kind = 0").groupBy("a", "b", "cls").agg(F.sum("n").alias("n")).where(F.col("n") >= half[F.col("cls").cast("int")]).select("a", "b", "cls")
    common = met.where("kind = 2").select(F.col("a").alias("key"), "b", "cls")
    rich = common.groupBy("b", "cls").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= half[F.col("cls").cast("int")]).select("b", "cls")
    if not whole:
        rare, rich = alone(alone(rare, "a"), "b"), alone(rich, "b")
    members = common.join(rich, ["b", "cls"])
    # a linked pair meets in the class of its smaller set; a document is in a group of each class that it has candidates in
    near = settle(rare.unionByName(with_whole(members, "key", "b", F.min("b"), F.min, "a").select("a", "b", "cls")).where("a <> b").distinct())
    # nodes are hashes of id and class; where two are equal, groups are one, which costs comparisons only
    in_class = lambda x: F.xxhash64(x, "cls")
    nodes = near.select(F.col("a").alias("id"), in_class("a").alias("node")).unionByName(near.select(F.col("b").alias("id"), in_class("b").alias("node"))).distinct()
    groups = components(near.select(in_class("a").alias("a"), in_class("b").alias("b"))).join(nodes, "node").select("id", "root").distinct()
    sized = with_whole(groups, "root", "id", F.count(F.lit(1)), F.sum, "n")
    chunks = sized.select("id", "root", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    chunks = settle(chunks.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))
    drop_settled(near)

    def to_sets(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column(1), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), *b.columns[2:]], names=["id", "set", *b.schema.names[2:]])

    def compare(star, table):
        """Links (a, b, group) of each pair of chunks; with ``star``, (id, null, group) too for sets that reach the first chunk's largest component."""
        groups: dict = {}
        cols = [table.column(c).to_pylist() for c in ("root", "i", "j", "left", "id")]
        for k, (root, i, j, left, doc) in enumerate(zip(*cols, strict=True)):
            groups.setdefault((root, i, j), ([], []))[not left].append((doc, k))
        blob, out = table.column("set"), []
        for (root, i, j), sides in groups.items():
            left, right = (sorted(x, key=lambda d: (d[0], blob[d[1]].as_py())) for x in sides)
            a, b = (SignatureTree([np.frombuffer(blob[k].as_buffer(), np.uint64) for _, k in x]) if x else None for x in (left, right))
            # in every task of a star the first chunk is the same and comes to the same components
            own = find(a, a, num, den) if left and (star or not right and i == j) else []
            across = find(a, b, num, den) if left and right else []
            out += [(left[x][0], left[y][0], root) for x, y in (own if not right else [])] + [(left[x][0], right[y][0], root) for x, y in across]
            if star and left:
                n, m = len(left), len(left) + len(right)
                x, y = (np.array(z, np.int64) for z in zip(*own)) if own else (np.zeros(0, np.int64),) * 2
                core = np.bincount(local_roots(n, x, y)).argmax()
                p, q = (np.array(z, np.int64) for z in zip(*across)) if across else (np.zeros(0, np.int64),) * 2
                up = local_roots(m, np.concatenate([x, p]), np.concatenate([y, q + n]))
                ids = [d for d, _ in (*left, *right)]
                out += [(ids[k], None, root) for k in np.flatnonzero(up == up[core]).tolist() if k >= n or not right]
        return pa.table([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["a", "b", "root"])

    def compared(placed, pairs, star=False):
        """Links between the documents (id, root) of each pair of chunks that ``pairs``, an array of (i, j, left), has them in."""
        # a merge join at every size: the candidates grow with the table
        sets = named.join(placed.select("id", "root", pairs.alias("pairs")).hint("merge"), "id").select("id", "text", "root", "pairs").mapInArrow(to_sets, "id long, set binary, root long, pairs array<struct<i:int,j:int,left:boolean>>")
        dealt = sets.select("id", "set", "root", F.inline("pairs")).withColumn("task", F.pmod(F.xxhash64("root", "i", "j"), F.lit(2 * n)).cast("int"))
        return group_messages(dealt, "task", lambda table: compare(star, table), "a long, b long, root long")

    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), left.alias("left"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own, first = F.col("chunk"), F.lit(0)
    every = F.transform(upto("chunks"), lambda k: place(F.least(k, own), F.greatest(k, own), own <= k))
    settled = [met, chunks] if whole else [met, chunks, copies]
    if whole or not chunks.where("chunks > 2").limit(1).count():
        return compared(chunks, every).select("a", "b"), equal, settled
    star = F.when(own == 0, F.transform(upto("chunks"), lambda k: place(first, k, F.lit(True)))).otherwise(F.array(place(first, own, F.lit(False))))
    links = settle(compared(chunks.where("chunks > 2"), star, True))
    inside = links.where("b is null").select(F.col("a").alias("id"), "root", F.lit(True).alias("inside")).distinct()
    # sets outside the core of their group meet all others of it
    seen = chunks.where("chunks > 2").join(inside, ["id", "root"], "left").select("id", "root", "chunk", "chunks", F.col("inside").isNull().alias("out"))
    # both counts of a group in one number: outsiders below, the others above
    parted = with_whole(seen, "root", "id", F.sum(F.when(F.col("out"), F.lit(1)).otherwise(F.lit(1 << 32))), F.sum, "both").withColumn("outside", F.col("both") % (1 << 32)).where("outside > 0")
    parted = parted.withColumn("sets", F.ceil(F.col("outside") / chunk).cast("int")).withColumn("others", F.ceil(F.floor(F.col("both") / (1 << 32)) / chunk).cast("int"))
    parted = settle(parted.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(1)), F.when(F.col("out"), F.col("sets")).otherwise(F.col("others"))).cast("int")).select("id", "root", "out", "sets", "others", "mine"))
    m = F.col("mine")
    among = F.transform(upto("sets"), lambda k: place(F.least(k, m), F.greatest(k, m), m <= k))
    with_others = F.when(F.col("others") > 0, F.transform(upto("others"), lambda k: place(m, F.col("sets") + k, F.lit(True)))).otherwise(F.slice(among, 1, 0))
    from_others = F.transform(upto("sets"), lambda k: place(k, F.col("sets") + m, F.lit(False)))
    # the small groups go with them, a pair of chunks each
    rest = parted.select("id", "root", F.when(F.col("out"), F.concat(among, with_others)).otherwise(from_others).alias("pairs"))
    small = chunks.where("chunks <= 2").select("id", "root", every.alias("pairs"))
    rest = compared(rest.unionByName(small), F.col("pairs"))
    return links.where("b is not null").unionByName(rest).select("a", "b"), equal, [*settled, links, parted]


#: Set digest and id.
_SET = np.dtype([("x", "<u8"), ("y", "<u8"), ("id", "<i8")])


def jaccard_components(df: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document: id_col, n_shingles and component_id, the smallest id that links of Jaccard num/den reach.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. Fewer words than a
    shingle: the whole sequence is one. Null text or none: an empty set that
    links with nothing; its component is its own id. Very long texts are taken
    whole. Ids must be whole numbers; rows of one id are one document for
    linking, each with its own n_shingles. A null id has no component. Equal
    sets link. Other columns are not read. Empty table: no rows. ``chunk``:
    documents of a chunk; the result is the same for any number.
    """
    found = jaccard_roots(df, shingle, num, den, id_col, text, chunk)
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in shingle_sets(b.column(1), shingle)], pa.int64())], names=["id", "n_shingles"])

    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(count, "id long, n_shingles long")
    out = base.join(found.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").cast(id_type).alias(id_col), "n_shingles", F.coalesce("root", "id").cast(id_type).alias("component_id"))


def _packed_ids(owner: np.ndarray) -> tuple[bytes, bytes]:
    """Ids once each, and the place of each entry's among them."""
    u, at = np.unique(owner, return_inverse=True)
    return u.tobytes(), at.astype(np.uint32).tobytes()

