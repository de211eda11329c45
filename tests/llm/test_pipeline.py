import brute
import pytest

import corpus_pipeline as cp

D = "/root/testdata/sf0.001"


def texts(df):
    return sorted(((str(r["doc_id"]), r["text"]) for r in df.collect()), key=str)


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{D}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = cp.settle(stage(spark, docs, D))
        assert docs.columns == cp.COLUMNS
        seen[name] = before, sorted((r["doc_id"], r["text"]) for r in docs.collect())
    before, after = seen["near_copies"]
    assert [x for x, _ in after] == [x for x, _, root in brute.jaccard(before, 5, 8, 10) if x == root]
    before, after = seen["repeats"]
    assert after == [(x, kept) for x, *_, kept in brute.substrings(before)]
    out = cp.run(spark, D)
    assert out.select("doc_id").distinct().count() == len(after)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns that clash with the operators' own."""
    plain = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, plain[0]), (1, plain[0]), (1, plain[1]), (None, plain[0]), (None, plain[2]), (None, plain[2]), (5, None), (5, None), (6, ""), (7, plain[3] + " x"), (8, plain[3]), (None, None), (9, " ".join(f"z{i % 9000}" for i in range(30_000)))]
    full = [(d, t, None if k % 2 else "en", None if k % 3 else "web", None, 0.5, "k", k, "s") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, block int, root string").repartition(3)


def test_stages_take_odd_rows(spark, odd):
    for name, stage in cp.STAGES:
        out = stage(spark, odd, D)
        assert name == "packing" or out.columns == cp.COLUMNS
        none = stage(spark, odd.limit(0), D)
        assert none.count() == 0 and none.columns == out.columns
        if name in ("quality", "toxicity"):
            assert set(texts(out)) <= set(texts(odd))
            if name == "toxicity":
                assert out.count() == odd.count()
        elif name == "packing":
            assert out.where("start = 0").count() == odd.count()


def test_one_of_equal_rows_stays(spark, odd):
    got = texts(cp.near_copies(spark, odd, D))
    assert sum(not t for _, t in got) == 4
    ids = dict((t, d) for d, t in got if t)
    assert sorted(ids.values()) == ["1", "1", "7", "9", "None"]


def test_repeats_keeps_every_row(spark, odd):
    out = cp.repeats(spark, odd, D)
    assert out.count() == odd.count() and out.where("text is null or n_chars <> length(text)").count() == 0
    words = sum(len(t.split()) for _, t in texts(out))
    assert words == 60 * 4 + 1 + 9000
