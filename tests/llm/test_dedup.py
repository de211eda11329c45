import brute
import numpy as np
import pytest

from vecloom.llm import blocks, common, jaccard, neardup, substring, suffix


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 5] + rng.normal(size=8) * 0.12]) for i in range(60)]
    rows += [(200 + i, rows[7][1]) for i in range(20)] + [(230, [2 * x for x in rows[7][1]])]
    rows += [(300, None), (301, [0.0] * 8), (302, [None] + [1.0] * 7), (303, [float("nan")] * 8), (304, [float("inf")] + [1.0] * 7), (305, []), (306, [1.0, 0.0]), (307, [1.0, 0.01]), (308, [1e200, 1e198]), (309, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = {r[0]: r for r in brute.near([r for r in rows if r[0] < 308], 0.95)}
    got = {r[0]: tuple(r) for r in neardup.near_duplicates(df).collect()}
    assert {k: v for k, v in got.items() if k < 306} == {k: v for k, v in want.items() if k < 306}
    assert [got[k][1:3] for k in (306, 307, 308, 309)] == [(3, 306)] * 4
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_cells_miss_no_pair():
    rng = np.random.default_rng(1)
    u = neardup.unit_rows(np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(1, 6)) + rng.normal(size=(100, 6)) * 0.2]))
    c = neardup.spherical_kmeans(u, 12)
    home, row, cell = neardup.cells_of(u, c, 0.95)
    inside = set(zip(row.tolist(), cell.tolist()))
    assert len(inside) == len(row) and all((k, home[k]) in inside for k in range(len(u)))
    for i, j in zip(*np.nonzero(u @ u.T >= 0.95)):
        assert (j, home[i]) in inside


def test_recall_of_the_nearest_cells():
    """Against brute force: 2,000 planted partners at the threshold among random vectors, a twentieth of all pairs compared."""
    rng = np.random.default_rng(2)
    u = neardup.unit_rows(rng.normal(size=(20_000, 64)))
    w = rng.normal(size=(2000, 64))
    w -= (w * u[:2000]).sum(1, keepdims=True) * u[:2000]
    u = np.concatenate([u, 0.951 * u[:2000] + (1 - 0.951**2) ** 0.5 * neardup.unit_rows(w)])
    k = int(len(u) ** 0.5) // 2 + 1
    home, row, cell = neardup.cells_of(u, neardup.spherical_kmeans(u[rng.permutation(len(u))[: 32 * k]], k), 0.95, neardup.VISITS)
    inside = set(zip(row.tolist(), cell.tolist()))
    found = [(20_000 + i, home[i]) in inside for i in range(2000)] + [(i, home[20_000 + i]) in inside for i in range(2000)]
    assert np.mean(found) >= 0.99
    assert np.bincount(home, minlength=k) @ np.bincount(cell, minlength=k) < 0.12 * len(u) ** 2


def test_many_cells_in_little_memory():
    import resource

    rng = np.random.default_rng(3)
    c, u = neardup.unit_rows(rng.normal(size=(4096, 64))), neardup.unit_rows(rng.normal(size=(2048, 64)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for visits in (neardup.VISITS, None):
        assert len(neardup.cells_of(u, c, 0.95, visits)[0]) == 2048
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # in KB


def test_near_duplicates_all_cells_and_blocks(spark, monkeypatch):
    """Every link where all cells within reach are visited, several blocks to a cell, ids that repeat."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(150, 5)), rng.normal(size=(1, 5)) + rng.normal(size=(60, 5)) * 0.15])
    rows = [(int(i), [float(x) for x in y]) for i, y in enumerate(v)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), visits=None)
    assert tuples(got) == brute.near(rows, 0.95)
    twice = neardup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id int, embedding array<double>"))
    assert sorted(map(tuple, twice.collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, None)]
    with pytest.raises(TypeError, match="whole numbers"):
        neardup.near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_suffixes(documents, corpus, nothing):
    assert tuples(suffix.deduplicate(documents)) == brute.suffixes(corpus)
    assert suffix.deduplicate(nothing).count() == 0


def test_suffixes_of_repeated_rows_and_kept_bytes(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, "x" + text[:210]), (None, text[:199])], "doc_id int, text string")
    got = tuples(suffix.deduplicate(df.where("doc_id is not null"), kept="rest"))
    assert [g[2] for g in got] == [300, 300, 210] and bytes(got[2][5]) == b"x"
    assert suffix.deduplicate(df).where("doc_id is null").first()["n_removed"] == 0


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_suffixes_of_crowded_sides(spark, hot):
    """A line with many different surroundings, a line of one letter, near copies: whether dealt as contexts or one by one."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line, long = word(230), word(900)
    rows = [(k, word(int(rng.integers(0, 260))) + line + word(int(rng.integers(0, 260)))) for k in range(25)]
    rows += [(30 + k, long[:450] + word(3) + long[450:]) for k in range(6)] + [(40, "z" * 700), (41, "z" * 199), (42, line), (42, None), (43, line)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    assert tuples(suffix.deduplicate(df, hot=hot)) == brute.suffixes(rows)


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffixes_of_rows_in_any_order(spark, documents, corpus, monkeypatch, hot):
    """Between executors a shuffle brings a block's rows in another order each round; rows of one id, or without one, too."""
    turn = iter((1, -1))

    def shuffled(docs, replies, f, *schema):
        step = next(turn)
        return blocks.answer(docs, replies, lambda table, own: f(table.take(list(range(len(table)))[::step]), own), *schema)

    monkeypatch.setattr(suffix, "answer", shuffled)
    rows = [((None, 0, d)[k % 3], t) for k, (d, t) in enumerate(corpus)]
    got = suffix.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), hot=hot).collect()
    want = brute.suffixes([(k, t) for k, (_, t) in enumerate(rows)])
    assert sorted(map(tuple, got), key=str) == sorted(((d, *x[1:]) for (d, _), x in zip(rows, want, strict=True)), key=str)


def test_memory_of_a_crowded_side():
    """200,000 surroundings of one line: the strings of a block are hashed a stretch at a time, contexts are at most HOT."""
    import resource

    import pyarrow as pa

    rng = np.random.default_rng(6)
    line = bytes(rng.integers(97, 123, 220, dtype=np.uint8))
    own = rng.integers(97, 123, (200_000, 60), dtype=np.uint8)
    t = suffix._Texts(pa.table({"text": pa.array([(x[:30].tobytes() + line + x[30:].tobytes()).decode() for x in own])}))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found, _, times = suffix.unique_pairs(t.strings((280 * np.arange(20_000)[:, None] + np.arange(81)).ravel()))
    assert (times == 20_000).sum() == 21 and times.sum() == 81 * 20_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600 << 10  # in KB


def test_difference_cover():
    seen = {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER}
    assert seen == set(range(suffix.PERIOD))


@pytest.mark.parametrize("shingle,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard(documents, corpus, nothing, shingle, num, den):
    assert tuples(jaccard.jaccard_components(documents, shingle, num, den)) == brute.jaccard(corpus, shingle, num, den)
    assert jaccard.jaccard_components(nothing).count() == 0


def test_jaccard_gives_every_link(spark):
    """A chain of near copies and copies of its members, in one slice and in several."""
    words = [f"w{i}" for i in range(200)]
    near = [" ".join([*words[: 200 - 5 * k], *(f"v{k}x{i}" for i in range(5 * k))]) for k in range(6)]
    rows = [(10 * k + c, near[k]) for k in range(6) for c in range(3)] + [(90, "lone words only here"), (91, None), (92, "")]
    sets = {d: set(zip(*([(t or "").split()[i:] for i in range(3)]))) for d, t in rows}
    want = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for slices in (1, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(slices)
        assert tuples(jaccard.jaccard_links(df, 3, 90, 100)) == sorted(want)
    assert {(0, 10), (0, 20), (10, 20), (0, 1)} <= set(want) and (0, 50) not in want


def test_jaccard_keys_meet():
    rng = np.random.default_rng(2)
    for num, den in ((9, 10), (8, 10)):
        parts = jaccard.Parts(num, den)
        for n in (1, 2, 5, 9, 10, 20, 33, 60, 150, 400):
            for _ in range(40):
                s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                spoilt = parts.differ(len(s))
                drop = int(rng.integers(0, spoilt + 1))
                t = np.unique(np.concatenate([s[rng.permutation(len(s))[drop:]], rng.integers(0, 1 << 63, spoilt - drop, dtype=np.uint64)]))
                if jaccard.linked(s, t, num, den):
                    both = np.intersect1d(parts.keys(s), parts.keys(t)) & np.uint64(255)
                    per = {int(c): int((both == c).sum()) for c in np.unique(both)}
                    assert any(c >= 128 or k >= 2 * parts.half(c) - 1 for c, k in per.items()), (n, per)


def test_linked_sets_share_their_number_of_keys():
    """Of parts or, where many are empty, of smallest shingles."""
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (8, 10), (1, 2)):
        parts, prefixes = jaccard.Parts(num, den), 0
        for n in (1, 2, 3, 4, 6, 9, 14, 20, 33, 48, 62, 85, 160, 215, 400):
            for _ in range(60):
                s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                spoilt = parts.differ(len(s))
                drop = int(rng.integers(0, spoilt + 1))
                t = np.unique(np.concatenate([s[rng.permutation(len(s))[drop:]], rng.integers(0, 1 << 63, spoilt - drop, dtype=np.uint64)]))
                if jaccard.linked(s, t, num, den):
                    both = np.intersect1d(parts.keys(s), parts.keys(t)) & np.uint64(255)
                    enough = [c for c in np.unique(both).astype(int).tolist() if (both == c).sum() >= 2 * parts.half(c) - 1]
                    assert enough, (num, n)
                    prefixes += max(enough) >= 128
        assert prefixes > 20


def test_chains_of_candidates_stay_in_a_class(spark, monkeypatch):
    """Each is a window over the same words that overlaps with the next, none links; sizes grow along the chain."""
    rows, at = [], 0.0
    for i in range(24):
        size = 60 * 1.1**i
        rows.append((i, " ".join(f"w{k}" for k in range(int(at), int(at + size)))))
        at += size / 5
    rows.append((100, rows[5][1] + " end"))
    groups = []
    whole = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: groups.append(whole(edges)) or groups[-1])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 8, 10)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: 5 if d == 100 else d for d, _ in rows}
    sizes = [r["count"] for r in groups[0].groupBy("root").count().collect()]
    assert sum(sizes) > 12 and max(sizes) <= 8


@pytest.mark.parametrize("local", [0, 1 << 16])
def test_components_by_rounds_and_in_a_task(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL", local)
    rng = np.random.default_rng(4)
    chain, star = [(k + 1, k) for k in range(100, 140)], [(500, 500 + k) for k in range(1, 60)]
    mixed = [*map(tuple, rng.integers(1000, 1200, (120, 2)).tolist()), (-(1 << 62), 1 << 62), (7, 7)]
    for edges in ([], [(2, 9), (9, 2), (2, 11)], chain + star + mixed):
        nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
        root = common.local_roots(len(nodes), *(np.array([nodes.index(e[c]) for e in edges if e[0] != e[1]], np.int64) for c in (0, 1)))
        got = common.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3))
        assert sorted(map(tuple, got.collect())) == [(x, nodes[r]) for x, r in zip(nodes, root.tolist(), strict=True)]


def test_components_of_small_tables_take_few_stages(spark):
    """Each shuffle costs the driver a thread for a minute, and memory, so a small table must not take the rounds of a large one."""
    sc = spark.sparkContext
    sc.setJobGroup("few stages", "")
    try:
        assert common.components(spark.range(1000).selectExpr("id a", "id + 1 b")).where("root <> 0").isEmpty()
        jobs = sc.statusTracker().getJobIdsForGroup("few stages")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs) <= 12


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words, f"own{i}"]) if i % 2 else " ".join(words)) for i in range(700)] + [(5000 + i, " ".join(f"z{rng.integers(1e9)}" for _ in range(100))) for i in range(50)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100)
    assert {r["component_id"] for r in got.where("doc_id < 1000").collect()} == {0}
    assert got.where("doc_id >= 5000 and component_id = doc_id").count() == 50


@pytest.mark.parametrize("chunk", [3, 40])
def test_groups_of_many_chunks(spark, chunk):
    """Groups whose sets link in chains, in islands and not at all, equal sets in several slices, ids of several texts."""
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*words[: 100 - k], *(f"v{i}" for i in range(k))])) for k in range(0, 90, 3)]  # a chain
    rows += [(200 + k, " ".join([*words[:50], *(f"own{k}x{i}" for i in range(3))])) for k in range(20)] + [(300 + k, " ".join(words)) for k in range(30)]
    rows += [(400 + k, " ".join([*words[:60], *(f"far{k // 4}x{i}" for i in range(40))])) for k in range(24)]  # islands
    rows += [(500, " ".join(words)), (500, " ".join(f"q{i}" for i in range(30))), (501, " ".join(f"q{i}" for i in range(30))), (502, " ".join(f"q{i}" for i in range(29)))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), 3, 8, 10, chunk=chunk)
    texts = dict(rows[:-4]) | {500: rows[-4][1], 1500: rows[-3][1], 501: rows[-2][1], 502: rows[-1][1]}
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for d, t in texts.items()}
    pairs = [(a % 1000, b % 1000) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])] + [(500, 500)]
    want = brute.roots(sorted({d for d, _ in rows}), pairs)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_substrings(documents, corpus, nothing):
    assert tuples(substring.deduplicate(documents)) == [x[:4] for x in brute.substrings(corpus)]
    kept = {r["doc_id"]: (r["kept"], r["source"]) for r in substring.deduplicate(documents, kept="kept", carry=("source",)).collect()}
    assert kept == {d: (k, None if d % 7 == 0 else f"src{d % 3}") for d, *_, k in brute.substrings(corpus)}
    assert substring.deduplicate(nothing).count() == 0


def test_substrings_edges(spark):
    """Repeated ids and rows, null ids, batches of any number: one result."""
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(5, text[0]), (5, text[0]), (5, None), (None, text[1]), (None, text[2] + " " + text[1]), (7, text[1]), (9, text[3]), (11, text[3] + " x " + text[2])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = [sorted(map(tuple, substring.deduplicate(df, batches=b).collect()), key=str) for b in (1, 3)]
    assert got[0] == got[1]
    gone = sorted((str(r[0]), r[1] - r[2]) for r in got[0])
    assert [k for i, k in gone if i == "5"] == [0, 0, 40] and [dict(gone)[i] for i in ("7", "9", "11")] == [0, 40, 1]
    assert sum(k for i, k in gone if i == "None") == 80
    for f in (substring.deduplicate, suffix.deduplicate, jaccard.jaccard_components):
        with pytest.raises(TypeError, match="whole numbers"):
            f(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("merged", [False, True])
def test_substrings_against_history(spark, corpus, merged):
    """Three earlier tables of unequal sizes and the new one, in batches: one pass over all."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    tables = [frame(corpus[:5]), frame(corpus[5:24]), frame(corpus[24:30])]
    runs = tables[0].sparkSession.createDataFrame([], substring.RUN)
    for t in tables:
        runs = runs.unionByName(substring.index_of(t, buckets=5))
    runs = substring.settle(substring.compact(runs) if merged else runs)
    assert {r["level"] for r in runs.collect()} <= ({0, 1} if merged else {0})
    want = {x[0]: x[:4] for x in brute.substrings(corpus)}
    got = {r[0]: tuple(r) for r in substring.deduplicate(frame(corpus[30:]), history=runs, batches=2).collect()}
    assert got == {d: want[d] for d, _ in corpus[30:]}
    assert sum(r[2] for r in got.values()) > sum(x[2] for x in brute.substrings(corpus[30:]))


def test_runs_of_other_settings_are_an_error(spark, corpus):
    new = spark.createDataFrame(corpus[30:], "doc_id bigint, text string")
    a, b = (substring.index_of(new, buckets=n) for n in (3, 13))
    with pytest.raises(ValueError, match="buckets"):
        substring.deduplicate(new, history=a.unionByName(b))
    with pytest.raises(ValueError, match="window"):
        substring.deduplicate(new, window=21, history=a)


def test_merge_join_and_runs():
    rng = np.random.default_rng(0)
    pick = lambda n: substring.merged([np.array(list(zip(rng.integers(0, 40, n), rng.integers(0, 3, n))), substring._FINGER)])
    for _ in range(200):
        run, batch = pick(int(rng.integers(0, 30))), pick(int(rng.integers(0, 30)))
        assert substring.merge_join(run, batch).tolist() == [x in run.tolist() for x in batch.tolist()]
    flat = np.array(list(zip(rng.integers(0, 60, 300), rng.integers(0, 2, 300))), substring._FINGER)
    runs, seen, want = [pick(20), pick(9)], set(), []
    for r in runs:
        seen |= set(r.tolist())
    for x in flat.tolist():
        want.append(x in seen)
        seen.add(x)
    got, new = substring.seen_before(flat, runs)
    assert got.tolist() == want
    assert substring.merged([*runs, new]).tolist() == sorted(seen)


def test_index_compacts_levels(spark):
    """Runs of one level become one of the next: the number of runs grows with the logarithm of the batches."""
    index = substring.Index(spark, 20, 2)
    for k in range(9):
        flat = np.array([(k, 1), (100 + k, 1)], substring._FINGER)
        index.add(substring.settle(spark.createDataFrame([(b, bytearray(flat[b : b + 1].tobytes())) for b in (0, 1)], "bucket int, a binary")))
    assert [level for level, _ in index.levels] == [2]
    rows = {r["bucket"]: np.frombuffer(bytes(r["a"]), substring._FINGER)["k"].tolist() for r in index.runs().collect()}
    assert rows == {0: list(range(9)), 1: list(range(100, 109))}
