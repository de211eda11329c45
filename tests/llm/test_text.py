import itertools
import math
import zlib

import brute
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from oracle import same

from vecloom.llm import media, pack, pieces, quality, shard, toxicity
from vecloom.llm.queries import ORACLE, QUERIES, held_out

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name], SF)


def test_grammar():
    lex = toxicity.Lexicon({"idiot": 1.0, "stup*": 1.0})
    score = lambda t: toxicity.score_text(t, lex)[0]
    assert score(None) == score("") == score("fine words") == score("idiotic") == 0 < score("an IDIOT") < 1
    assert score("you idiot") > score("the idiot") > score("not an idiot")
    assert score("she said: the idiot") == score("the idiot") > score("someone said the idiot")
    assert score("stupidity") > 0 and score("İ" * 50 + " stupid") > 0
    assert toxicity.score_text("x. " * 5000 + "you idiot. Bye", lex)[2][0][2] > 1


def test_whole_word_leaves_the_stem_of_its_letters():
    for stems in ({"kill*": 1.9, "kill": 1.0}, {"kill": 1.0, "kill*": 1.9}):
        lex = toxicity.Lexicon(stems)
        assert [toxicity.score_text(t, lex)[0] for t in ("killing", "kill")] == [pytest.approx(1 - math.exp(-1.9))] * 2
    assert toxicity.score_text("killing", toxicity.Lexicon({"kill": 1.0}))[0] == 0
    learned = toxicity.select_stems({"kill*": (20, 0), "kill": (10, 0), "killing": (10, 0)}, 40, 4000)
    assert toxicity.score_text("killing", toxicity.Lexicon(learned))[0] >= 0.5


def test_grammar_decides():
    """Learned stems: a plain insult is toxic, a single one negated or reported is not; threats need someone they are aimed at."""
    for seen in ((60, 0), (10, 0), (3, 0), (290, 0)):
        learned = toxicity.select_stems({"tras*": (max(4, seen[0]), seen[1])}, 290, 2233)
        toxic = lambda t: toxicity.score_text(t, toxicity.Lexicon(learned))[0] >= 0.5  # noqa: B023, E731
        assert toxic("this is trash") and toxic("you are trash") and toxic("not trash, but trash all the same and more trash")
        for text in ("this is not trash", "you are not trash", "the note said trash", "the report said it was not trash", "they said you are not trash"):
            assert not toxic(text), text
    toxic = lambda t: toxicity.score_text(t, toxicity.Lexicon({}, toxicity.THREATS))[0] >= 0.5
    for text in ("i will kill you", "we hurt all of them", "ich werde dich töten", "je vais te tuer", "hurt things, kill you"):
        assert toxic(text), text
    for text in ("kill the process", "killing you", "they kill time", "i will not kill you", "the note said kill them", "kill. you", "kill one two three you"):
        assert not toxic(text), text


def test_rare_insult_beside_a_large_vocabulary(spark):
    """60,000 and more stems that toxic rows hold more often, clean rows too."""
    rng = np.random.default_rng(6)
    words = sorted({"".join(map(chr, w)) for w in rng.integers(97, 123, (11_500, 9))})
    assert len(toxicity.stem_features(" ".join(words))) > 60_000
    rows = [(i, " ".join(rng.permutation(words)) + (" vile" if i < 10 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id bigint, toxic int")
    lex = toxicity.learn_lexicon(docs, labels)
    assert set(lex.stems) == {"vile"} and set(lex.threats) == set(toxicity.THREATS)


def test_toxicity_held_out(spark):
    """Held-out accuracy, and what each machine decides there."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    lex = toxicity.learn_lexicon(docs, labels.where(~held_out("doc_id")))
    rows = [(r["text"], r["toxic"]) for r in docs.join(labels.where(held_out("doc_id")), "doc_id").collect()]
    found = [toxicity.score_text(t, lex) for t, _ in rows]
    marked = [s >= 0.5 for s, *_ in found]
    clean = [m for m, (_, y) in zip(marked, rows, strict=True) if y == 0]
    assert sum(m == y for m, (_, y) in zip(marked, rows, strict=True)) >= 0.96 * len(rows) and sum(clean) <= 0.02 * len(clean)

    without = lambda m: toxicity.Product(*[x for x in toxicity.GRAMMAR.machines if x is not m])
    hits = [(c, next(iter(h))) for (t, _), (_, _, spans) in zip(rows, found, strict=True) for x, y, w in spans if len(h := lex.hits((c := t[x:y]).lower())) == 1 and 0.69 < w < 0.86]
    assert len(hits) > 100
    toxic = lambda texts, **k: sum(toxicity.score_text(t, lex, **k)[0] >= 0.5 for t in texts) / len(texts)
    assert toxic([c for c, _ in hits]) == 1
    for machine, plant in ((toxicity.NEGATION, "not a "), (toxicity.REPORT, "the note said ")):
        planted = [c[:at] + plant + c[at:] for c, at in hits if "said" not in c]
        assert toxic(planted) <= 0.05 and toxic(planted, grammar=without(machine)) >= 0.95
    moved = [toxicity.score_text(t, lex, without(toxicity.ADDRESS))[0] != s for (t, y), (s, *_) in zip(rows, found, strict=True) if y == 1]
    assert sum(moved) >= 0.05 * len(moved)
    at_once = toxicity.Machine(0, {(k, "threat"): "aimed" for k in (0, "aimed")} | {("aimed", "*"): 0}, {})
    for aimed, whom in ((0, "the lamp"), (1, "you")):
        planted = [f"{c[:at]} kill {whom} {c[at:].partition(' ')[2]}" for c, at in hits if not set(c.lower().split()) & set(toxicity._CLASS)]
        assert len(planted) > 20 and abs(toxic(planted) - aimed) <= 0.1 and toxic(planted, aim_machine=at_once) >= 0.9


def test_toxicity_edges(spark, documents, nothing):
    labels = spark.createDataFrame([(0, 1), (3, None), (None, 1)], "doc_id bigint, toxic int")
    lex = toxicity.learn_lexicon(documents, labels)
    out = toxicity.score_documents(documents, lex, score="score")
    assert out.count() == documents.count() and out.where("score <> 0").count() == 0 and "kept" in out.columns
    assert toxicity.score_documents(nothing, toxicity.learn_lexicon(nothing, labels)).count() == 0


def test_quality(spark, documents, nothing):
    got = QUERIES["op4_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    model = quality.fit(documents)
    assert quality.score_quality(documents, model, score="score").where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(nothing, quality.fit(nothing)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    acc = [0.95, 0.9, 0.85, 0.9]
    v = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in acc], 1)
    p, _, prior = quality.expectation_maximisation(v)
    assert ((p > 0.5) == truth).mean() > 0.95 and abs(prior - 0.8) < 0.05


def test_expectation_maximisation_as_by_hand():
    """Two rounds over a few rows, one number at a time."""
    v = np.array([[1, 1, 0], [1, -1, 1], [-1, -1, 0], [0, 1, 1], [-1, 0, -1]])
    p = [0.1 if -1 in r else 0.9 for r in v.tolist()]
    for _ in range(2):
        like = {}
        for j in range(3):
            for k in (0, 1):
                n = {x: sum((p[i] if k else 1 - p[i]) for i in range(5) if v[i][j] == x) + (1.0 if (x == 1) == (k == 1) else 0.04) for x in (-1, 1)}
                like[j, k] = {x: n[x] / sum(n.values()) for x in n}
        prior = min(max(sum(p) / 5, 0.02), 0.98)
        new = []
        for i in range(5):
            good, bad = prior, 1 - prior
            for j in range(3):
                if v[i][j]:
                    good, bad = good * like[j, 1][v[i][j]], bad * like[j, 0][v[i][j]]
            new.append(good / (good + bad))
        p = new
    got, table, _ = quality.expectation_maximisation(v, rounds=2)
    assert np.allclose(got, p) and np.allclose(table[1, 0], [like[1, 0][-1], like[1, 0][1]])


def test_quality_scores_by_hand(spark, documents, corpus):
    """The whole text's words count, each by its share, and the numbers' buckets."""
    model = quality.fit(documents)
    assert np.abs(model.words).max() > 0 and np.abs(model.weights).max() > 0
    for r in quality.score_quality(documents, model, score="score").collect():
        t = r["text"] or ""
        buckets = [quality.word_buckets(pa.array([w]))[0][0] for w in brute.WORD.findall(t)]
        z = model.bias + sum(model.weights[quality.hashed(quality.stats(t))]) + sum(model.words[b] for b in buckets) / max(1, len(buckets))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_words_tell_what_numbers_cannot():
    """Rows of equal numbers whose posteriors differ by a word."""
    u = [np.array([5, 7 + k % 2], np.uint16) for k in range(400)]
    c = [np.full(2, 0.5, np.float32)] * 400
    w, held, bias = quality.train(np.zeros((400, 3), np.int64), u, c, np.array([0.95, 0.05] * 200), 0, 6)
    z = [bias + w[[0, 0, 0]].sum() + held[x].mean() for x in u[:2]]
    assert z[0] > 0.5 and z[1] < -0.5


def test_shards(documents, corpus, nothing):
    rows = shard.interleaved_shards(documents, 4).collect()
    assert len(rows) == len(corpus)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    for s in {r["source"] for r in rows}:
        n = [sum(r["source"] == s for r in x) for x in by.values()]
        assert max(n) - min(n) <= 2
    text = dict(corpus)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in rows)
    assert shard.interleaved_shards(nothing).count() == 0


def test_pack_histogram():
    rng = np.random.default_rng(1)
    for counts in ({2048: 3}, {100: 1000}, {1: 5000}, {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 50, 300))}):
        patterns = pack.pack_histogram(counts, 2048)
        placed = {}
        for n, lengths in patterns:
            assert n > 0 and sum(lengths) <= 2048
            for x in lengths:
                placed[x] = placed.get(x, 0) + n
        assert placed == counts


def _one_by_one(lengths, size):
    """Shortest-pack-first without a histogram: the longest piece next, into the pack with most room."""
    packs = []
    for x in sorted(lengths, reverse=True):
        k = max(range(len(packs)), key=lambda k: size - sum(packs[k]), default=None)
        if k is not None and size - sum(packs[k]) >= x:
            packs[k].append(x)
        else:
            packs.append([x])
    return packs


def test_packs_against_one_by_one():
    rng = np.random.default_rng(8)
    for size, n, top in ((64, 300, 64), (64, 300, 12), (100, 200, 40), (2048, 250, 900), (16, 1, 16)):
        lengths = rng.integers(1, top + 1, n).tolist()
        patterns = pack.pack_histogram({x: lengths.count(x) for x in set(lengths)}, size)
        assert sorted(x for k, p in patterns for x in p * k) == sorted(lengths) and all(sum(p) <= size for _, p in patterns)
        n_packs = sum(k for k, _ in patterns)
        assert -(-sum(lengths) // size) <= n_packs <= len(_one_by_one(lengths, size))
        at = {}
        for x, first, end, sequence, offset, each in pack.slots(patterns):
            for r in range(end - first):
                at.setdefault(sequence + r // each, []).append((offset + r % each * x, x))
        assert sorted(at) == list(range(n_packs))
        for held in at.values():
            held.sort()
            assert [o for o, _ in held] == [sum(x for _, x in held[:k]) for k in range(len(held))]
        assert len(pack.slots(patterns)) <= 63 * (2 * len(set(lengths)) + 1)


def test_packing(documents, corpus, nothing):
    from tokenizers import Tokenizer

    tok, size = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 64
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, size)
    rows = pack.pack_documents(documents, *args).collect()
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for d, t in corpus:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(docs[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for x in seqs.values():
        at = 0
        for r in sorted(x, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    assert sorted(seqs) == list(range(len(seqs)))
    assert pack.pack_documents(nothing, *args).count() == 0


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 9216, 9217, 70000])
def test_transport_stream(size):
    raw = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    payload = media.payload_of(raw)
    stream = media.mux(payload)
    p = media.demux(stream)
    assert p.payload == payload and len(payload) % 576 == 0 and payload.startswith(raw)
    assert p.timestamps == [i * media.TICKS for i in range(len(p.timestamps))] and p.random_access == [(k * media.UNIT, k * media.TICKS) for k in range(0, len(p.timestamps), media.RANDOM_ACCESS_EVERY)]
    for k in range(2, min(6, len(stream) // 188)):  # a lost packet, a broken table
        with pytest.raises(ValueError):
            media.demux(stream[: 188 * k] + stream[188 * (k + 1) :] if len(stream) // 188 > k + 1 else stream[:-1])
    with pytest.raises(ValueError):
        media.demux(stream[:20] + b"\x00" + stream[21:])


def test_stream_written_by_hand():
    """Another writer's stream: table packets in between, padding packets, a second stream, units without timestamps or lengths."""

    def packet(pid, cc, body, start=False, adapt=None):
        room = 184 - len(body)
        if adapt is None and room:
            adapt = b"" if room == 1 else b"\x00" + b"\xff" * (room - 2)
        head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if adapt is not None else 0x10) | cc])
        out = head + (bytes([len(adapt)]) + adapt if adapt is not None else b"") + body
        assert len(out) == 188
        return out

    def table(pid, section, cc):
        section += media.section_crc(section).to_bytes(4, "big")
        return packet(pid, cc, b"\x00" + section + b"\xff" * (183 - len(section)), start=True)

    pat = bytes.fromhex("00b00d0007c1000000 01e123".replace(" ", ""))
    pmt = bytes.fromhex("02b0170001c10000e0f1f0001be0f1f0000fe0f2f000")
    unit = b"\x00\x00\x01\xe0\x00\x00\x80\x00\x00" + b"a" * 175
    timed = b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05" + bytes([0x21, 0, 3, 0, 5]) + b"b" * 100
    rap = b"\x40" + b"\xff" * (183 - len(timed) - 1)
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    stream = [table(0, pat, 4), null, table(0x123, pmt, 9), packet(0xF1, 15, unit, True), packet(0xF2, 0, b"x" * 184), packet(0xF1, 0, b"A" * 184), table(0, pat, 5), null, packet(0xF1, 1, timed, True, rap), packet(0xF1, 2, b"B" * 30)]
    p = media.demux(b"".join(stream))
    assert p.payload == b"a" * 175 + b"A" * 184 + b"b" * 100 + b"B" * 30
    assert (p.pid, p.stream_type, p.timestamps, p.random_access) == (0xF1, 0x1B, [(1 << 15) + 2], [(359, (1 << 15) + 2)])
    with pytest.raises(ValueError, match="continuity"):
        media.demux(b"".join(stream[:5] + stream[6:]))


def test_media_features(documents, corpus, nothing):
    got = {r["doc_id"]: r for r in media.media_features(documents, with_media=True).collect()}
    for d, t in corpus:
        raw = (t or "").encode()
        assert got[d]["n_bytes"] == len(raw) and media.demux(bytes(got[d]["media"])).payload == media.payload_of(raw)
    assert media.media_features(nothing).count() == 0


def _all_ways(m, s):
    out = []
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        edge = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
        score, ids = 0.0, []
        for a, b in itertools.pairwise(edge):
            k = m.pieces.get(s[a:b])
            if k is None and b - a > 1:
                break
            score += m.unknown if k is None else m.scores[k]
            ids += [k] if k is not None else [m.byte_ids[x] for x in s[a:b].encode()]
        else:
            out.append((score, ids))
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["hello there", "aaaaaa b", "naïve ☃", "x\ny z", "a"])
def test_nbest_against_all_ways(text):
    m = pieces.model(P.path("piece_bpe_32k.model"))
    want = _all_ways(m, m.normalise(text))[:4]
    got = pieces.encode_nbest(m, [text], 4, {})[0]
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want])
    assert len({tuple(i) for _, i in got}) == len(got)
    assert all(m.decode(i) == text and math.isclose(s, next(x for x, y in _all_ways(m, m.normalise(text)) if y == i)) for s, i in got)


def test_nbest_of_random_texts():
    """Against all ways to cut, over letters, spaces, line ends and letters that the vocabulary lacks."""
    m, rng = pieces.model(P.path("piece_bpe_32k.model")), np.random.default_rng(7)
    texts = ["".join(rng.choice(list("aeinorst  the\nzé☃"), int(rng.integers(1, 12)))) for _ in range(60)]
    for t, got in zip(texts, pieces.encode_nbest(m, texts, 4, {}), strict=True):
        want = _all_ways(m, m.normalise(t))[:4]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want]), t
        assert all(m.decode(i) == t for _, i in got)


def test_ways_to_cut_are_found_once():
    """A segment that is near in many texts is searched in one; results don't depend on what the memo holds."""
    m = pieces.model(P.path("piece_bpe_32k.model"))
    texts = [f"{w} naïvely zq☃x {w}" for w in ("one", "two", "three", "four")] + [None, "", "one\n two", "zq☃x"]
    alone = [pieces.encode_nbest(m, [t], 3, {})[0] for t in texts]
    memo, searched = {}, []

    class Spy(type(m)):
        def nbest(self, segment, n):
            searched.append((segment, n))
            return super().nbest(segment, n)

    spy = Spy.__new__(Spy)
    spy.__dict__ = m.__dict__
    assert [x for k in range(0, len(texts), 2) for x in pieces.encode_nbest(spy, texts[k : k + 2], 3, memo)] == alone
    assert len(searched) == len(set(searched)) > 0
    assert alone[4] == alone[5] == [(0, [])]


def test_merge_order_counts_as_rank():
    m = pieces.model(P.path("piece_bpe_32k.model"))
    cut = lambda t: [m.piece_bytes[i].decode() for i in pieces.encode_nbest(m, [t], 1, {})[0][0][1]]
    assert cut("market opened") == [" market", " opened"]


def test_pieces(spark, documents, corpus, nothing):
    path = P.path("piece_bpe_32k.model")
    got = pieces.encode_documents(documents, path, with_ids=True)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(r["decoded_ok"] and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) for r in rows.values())
    assert rows[next(d for d, t in corpus if t is None)]["n_pieces"] == 0
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(got, path).collect()} == {d: t or "" for d, t in corpus}
    assert pieces.encode_documents(nothing, path).count() == 0


def test_held_out(spark):
    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_clauses_are_read_whole():
    lex = toxicity.Lexicon({"idiot": 1.0})
    far = "they said " + "word " * 400 + "idiot"
    assert toxicity.score_text(far, lex)[2] == [(0, len(far), pytest.approx(1.5 * 0.75))]
    assert toxicity.score_text(far.replace("word ", "word. ", 1), lex)[2][0][2] == pytest.approx(1.0)


def test_derived_tables_are_measured(spark, documents):
    from vecloom.llm.common import deal, input_bytes

    joined = documents.join(documents.select("doc_id"), "doc_id")
    assert 0 < input_bytes(joined) < 1 << 20 and deal(joined) == 8 and deal(documents.limit(0)) == 8
