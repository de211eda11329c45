"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Half as many cells as the root of the vectors' number. Every vector has a home
cell, and visits the cells whose centroids are nearest to it. Two vectors within
the angle of the threshold have like similarities to every centroid, so a
vector's links are found in its home cell, among its members and visitors, by
products of blocks of bounded size. Every pair that is found is exact; which
are found depends on the visits. With ``visits=None`` all are: a vector then
visits each cell whose bounding plane is within that angle of it, which in many
dimensions is most cells.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import components, local_roots, mix, settle, slices, whole_numbers

#: Rows of a block; two blocks meet in a task and are multiplied TILE by TILE rows.
BLOCK, TILE = 8192, 2048
#: At most so many vectors are taken to place the centroids, SHARE for each of them at least.
SAMPLE, SHARE = 16384, 4
#: Cells that a vector visits, its home among them.
VISITS = 8
#: Similarities that are held at once, and rows of a batch that is sent.
_HELD, _SENT = 1 << 21, 4096


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _slices(n: int, k: int):
    step = max(1, _HELD // max(1, k))
    return [(x, min(n, x + step)) for x in range(0, n, step)]


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit rows (fewer if there are fewer rows)."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(v[x:y] @ c.T).argmax(1) for x, y in _slices(len(v), len(c))])
        order = np.argsort(home, kind="stable")
        own, first = np.unique(home[order], return_index=True)
        total = np.zeros_like(c)
        total[own] = np.add.reduceat(v[order], first, axis=0)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def cells_of(u: np.ndarray, c: np.ndarray, threshold: float, visits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit row, and (row, cell) of each cell that it is in: home, and visited ones.

    A cell is visited only if its bounding plane is within the angle of the
    threshold; with ``visits``, only the nearest such, home among them.
    """
    sine = math.sqrt(max(0.0, 1 - threshold * threshold))
    homes, rows, cells = [], [], []
    for x, y in _slices(len(u), len(c)):
        sims = u[x:y] @ c.T
        home = sims.argmax(1)
        most = sims[np.arange(y - x), home][:, None]
        if visits is None or visits >= len(c):
            apart = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
            r, cell = np.nonzero((most - sims <= sine * apart + 1e-9) | (np.arange(len(c)) == home[:, None]))
        else:
            near = np.argpartition(-sims, visits - 1, axis=1)[:, :visits]
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ijk,ik->ij", c[near], c[home])))
            ok = (most - np.take_along_axis(sims, near, 1) <= sine * apart + 1e-9) & (near != home[:, None])
            r, j = np.nonzero(ok)
            r, cell = np.concatenate([np.arange(y - x), r]), np.concatenate([home, near[r, j]])
        homes.append(home)
        rows.append(r + x)
        cells.append(cell)
    join = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    return join(homes), join(rows), join(cells)


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float):
    """Stretches (i, j) of the pairs of unit rows of x and y with a cosine of at least the threshold.

    A product in single precision leaves out what is surely below; the rest is
    taken in double precision, and what is next to the threshold exactly.
    """
    margin = max(1e-4, 4e-7 * x.shape[1])
    for a in range(0, len(x), TILE):
        x32 = x[a : a + TILE].astype(np.float32)
        for b in range(0, len(y), TILE):
            i, j = np.nonzero(x32 @ y[b : b + TILE].astype(np.float32).T >= np.float32(threshold - margin))
            i, j = i + a, j + b
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                g = np.einsum("ij,ij->i", x[p], y[q])
                ok = g >= threshold
                for r in np.flatnonzero(np.abs(g - threshold) < 1e-12):
                    u, v = x[p[r]], y[q[r]]
                    ok[r] = math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v)) >= threshold
                yield p[ok], q[ok]


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", visits: int | None = VISITS) -> DataFrame:
    """Per vector: id_col, n_links (other vectors of cosine >= threshold), component_id (smallest id reachable), kept.

    ``visits``: cells that a vector visits (see above); None finds every link
    whatever the vectors. Centroids are placed by at most SAMPLE vectors, chosen
    by hash, and are at most a quarter as many; larger cells are compared in
    pairs of blocks. Null and zero vectors, and those with null or non-finite
    components, link with nothing and are kept. Vectors of different lengths
    never link; those of a length that the sample lacks share one cell. Equal
    vectors are compared once and counted each; rows of one id are vectors of
    their own. Vectors may be of any length that a worker can multiply in TILE
    rows. A null id gets no links, and null for component and kept. Ids must be
    whole numbers. threshold must be over 0. Empty table: no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if visits is not None and visits < 1:
        raise ValueError("visits must be positive")
    id_type = whole_numbers(df, id_col)
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    v = F.col(vector).cast("array<float>" if single else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    live = F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.when(live, v).alias("v"))
    reps = settle(base.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))

    k = min(SAMPLE // SHARE, math.isqrt(reps.count()) // 2 + 1)
    taken = reps.orderBy(F.xxhash64("rep"), "rep").select("v").limit(min(SAMPLE, 32 * k)).collect()
    by_length: dict[int, list] = {}
    for r in taken:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    centroids = {d: spherical_kmeans(unit_rows(np.array(x)), k) for d, x in by_length.items()}

    def placed(batch):
        """(length, home cells, rows, cells, rows of the batch) by length."""
        vs = [np.asarray(x.values) for x in batch]
        lengths = np.array([len(x) for x in vs])
        for d in np.unique(lengths):
            own = np.flatnonzero(lengths == d)
            u = unit_rows(np.stack([vs[r] for r in own]).astype(np.float64))
            yield int(d), *cells_of(u, centroids.get(int(d), np.eye(1, int(d))), threshold, visits), own, vs

    def count(batches):
        for b in slices(batches):
            for d, home, _, cell, _, _ in placed(b.column(0)):
                every, at_home = np.bincount(cell), np.bincount(home, minlength=int(cell.max()) + 1)
                at = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays([pa.array([f"{d}:{x}" for x in at]), pa.array(every[at]), pa.array(at_home[at])], names=["cell", "n", "home"])

    sizes = reps.select("v").mapInArrow(count, "cell string, n long, home long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("home").alias("home"))
    # only cells of several blocks come to the driver: at most visits x vectors / BLOCK
    blocks = {r["cell"]: (-(-max(1, r["home"]) // BLOCK), -(-r["n"] // BLOCK)) for r in sizes.where(F.col("n") > BLOCK).collect()}

    def send(batches):
        """A member at home stands on the left against each block, and every member on the right against each block of those at home."""
        for b in slices(batches):
            rep, n = np.asarray(b.column(0)), np.asarray(b.column(1))
            for d, home, row, cell, own, vs in placed(b.column(2)):
                deal_ = mix(rep[own].astype(np.int64).view(np.uint64))
                name, which, left, i, j = [], [], [], [], []
                for r, c in zip(row.tolist(), cell.tolist(), strict=True):
                    at = f"{d}:{c}"
                    ni, nj = blocks.get(at, (1, 1))
                    h = int(deal_[r])
                    if home[r] == c:
                        name += [at] * nj
                        which += [r] * nj
                        left += [True] * nj
                        i += [h % ni] * nj
                        j += range(nj)
                    name += [at] * ni
                    which += [r] * ni
                    left += [False] * ni
                    i += range(ni)
                    j += [h % nj] * ni
                which = np.array(which)
                blobs = [vs[r].astype(kind).tobytes() for r in own]
                for x in range(0, len(which), _SENT):
                    w, to = which[x : x + _SENT], slice(x, x + _SENT)
                    yield pa.RecordBatch.from_arrays([pa.array(name[to]), pa.array(i[to], pa.int32()), pa.array(j[to], pa.int32()), pa.array(left[to]), pa.array(rep[own][w]), pa.array(n[own][w]), pa.array([blobs[y] for y in w.tolist()], pa.binary())], names=["cell", "i", "j", "left", "rep", "n", "u"])

    dealt = reps.select("rep", "n", "v").mapInArrow(send, "cell string, i int, j int, left boolean, rep long, n long, u binary")

    def compare(table):
        left = np.asarray(table.column("left").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        u = unit_rows(np.stack([np.frombuffer(x.as_buffer(), kind) for x in table.column("u")]).astype(np.float64))
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        ids, links, other = [], [], []
        if len(a) and len(b):
            nodes, place = np.unique(rep, return_inverse=True)
            count, root = np.zeros(len(a)), np.arange(len(nodes))
            for i, j in linked_pairs(u[a], u[b], threshold):
                apart = rep[a[i]] != rep[b[j]]
                i, j = i[apart], j[apart]
                count += np.bincount(i, n[b[j]], len(a))
                root = local_roots(len(nodes), np.concatenate([np.arange(len(nodes)), place[a[i]]]), np.concatenate([root, place[b[j]]]))
            ids, links, other = rep[a].tolist(), count.astype(np.int64).tolist(), [None] * len(a)
            joined = np.flatnonzero(root != np.arange(len(nodes)))
            ids += nodes[joined].tolist()
            links += [0] * len(joined)
            other += nodes[root[joined]].tolist()
        return pa.table([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], names=["a", "links", "b"])

    found = settle(dealt.groupBy("cell", "i", "j").applyInArrow(compare, "a long, links long, b long"))
    roots = components(found.where("b is not null").select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    of_rep = reps.join(counts, reps["rep"] == counts["a"], "left").join(roots, reps["rep"] == roots["node"], "left")
    of_rep = of_rep.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = base.join(of_rep, "v", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").cast(id_type).alias(id_col), F.when(F.col("id").isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce("n_links", F.lit(0).cast("bigint"))).alias("n_links"), F.when(F.col("id").isNotNull(), component).cast(id_type).alias("component_id"), (F.col("id") == component).alias("kept"))
