"""Toxicity by a weighted finite-state grammar over clauses.

Lexical transducers rewrite words to classes: insult (stems learned from
labelled rows, with weights), threat (a fixed list), target, negation, reported
speech. Small machines for negation, reported speech and address run over a
clause's classes as one composed transducer; each insult it meets gives its
weight times what the machines' states say, and so does each threat that
another machine finds aimed at someone. A document's score is 1 - exp(-sum).
One plain insult or aimed threat makes 0.5; one negated or reported does not,
unless it is reported of someone whom the clause names before.
"""

import math
import re
from bisect import bisect_left
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import drop_settled, settle, slices

# fixed values: closed word classes of English, German, French and Spanish
TARGETS = "you your yours yourself u he she they them him her these those people du dich dir ihr euch sie tu toi te vous ils elles tú usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never nobody nothing without isn't aren't wasn't don't doesn't nicht kein keine niemals nie ohne ne pas jamais sans nunca jamás sin ni".split()
REPORTS = "said says say saying called calls calling wrote writes quoted quote quotes claimed claims alleged allegedly sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()
# targets that are objects wherever they stand
OBJECTS = "dich dir euch te".split()
THREATS = "kill murder hurt stab shoot destroy töten umbringen tuer frapper matar golpear".split()

_CLASS = {w: c for c, ws in (("target", TARGETS), ("object", OBJECTS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_CLAUSE_END = ".!?;:\n\r"
_END = re.compile(f"[{_CLAUSE_END}]")


class Machine:
    """A weighted finite-state machine over word classes: moves[(state, class)] -> state; weight[state] applies to what it meets there, if that is one of ``of``."""

    def __init__(self, start, moves, weight, of=("insult", "threat")):
        self.start, self.moves, self.weight, self.of = start, moves, weight, of

    def step(self, state, symbol):
        return self.moves.get((state, symbol), self.moves.get((state, "*"), state))


class Product:
    """Machines that run side by side as one, states composed as they are reached; their weights multiply."""

    def __init__(self, *machines: Machine):
        self.machines = machines
        self.start = tuple(m.start for m in machines)
        self._next: dict = {}

    def step(self, state, symbol):
        key = (state, symbol)
        if key not in self._next:
            self._next[key] = tuple(m.step(s, symbol) for m, s in zip(self.machines, state, strict=True))
        return self._next[key]

    def weight(self, state, symbol):
        return math.prod(m.weight.get(s, 1.0) for m, s in zip(self.machines, state, strict=True) if symbol in m.of)


# a negation holds for the three words after it
NEGATION = Machine(0, {(0, "negation"): 3, (3, "negation"): 3, (2, "negation"): 3, (1, "negation"): 3, (3, "*"): 2, (2, "*"): 1, (1, "*"): 0}, {3: 0.7, 2: 0.7, 1: 0.7})
# after a verb of saying, to the clause's end
REPORT = Machine(0, {(0, "report"): 1}, {1: 0.75})
# someone is spoken to or of earlier in the clause: (whether, words that a negation still holds for), and no negation holds
ADDRESS = Machine(
    (0, 0),
    {((a, k), "negation"): (a, 3) for a in (0, 1) for k in range(4)}
    | {((a, k), c): (1, max(k - 1, 0)) for a in (0, 1) for k in range(4) for c in ("target", "object")}
    | {((a, k), "*"): (a, k - 1) for a in (0, 1) for k in range(1, 4)},
    {(1, 0): 1.5},
    of=("insult",),
)
# a threat is aimed at someone within three words after it, or at an object earlier in the clause
AIM = Machine(
    0,
    {(k, "threat"): 3 for k in (0, 1, 2, 3, "aimed")}
    | {(k, c): "aimed" for k in (1, 2, 3) for c in ("target", "object")}
    | {(k, "object"): "object" for k in (0, "aimed")}
    | {(3, "*"): 2, (2, "*"): 1, (1, "*"): 0, ("aimed", "*"): 0, ("object", "threat"): "aimed"},
    {},
)
#: What an aimed threat weighs, if it is no learned stem of more weight.
AIMED = 0.8
GRAMMAR = Product(NEGATION, REPORT, ADDRESS)


class Lexicon:
    """Stems by their weight; a stem ending in * matches the beginnings of words, others whole words. Threats are whole words."""

    def __init__(self, stems: dict[str, float], threats: tuple[str, ...] = ()):
        self.stems, self.threats = dict(stems), tuple(threats)
        self.tree = ahocorasick.Automaton()
        # a stem and a whole word of the same letters are one key
        keys: dict[str, list[float]] = {}
        for s, w in stems.items():
            if core := s.rstrip("*"):
                keys.setdefault(core, [0.0, 0.0])[s.endswith("*")] = w
        for core in self.threats:
            keys.setdefault(core, [0.0, 0.0])
        for core, (whole, stem) in keys.items():
            self.tree.add_word(core, (len(core), whole, stem, core in self.threats))
        self.empty = not keys
        if not self.empty:
            self.tree.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.stems, self.threats)

    def hits(self, low: str) -> dict[int, tuple[float, bool]]:
        """Start of each matched word, its weight as an insult (0: none), and whether it is a threat."""
        found: dict[int, tuple[float, bool]] = {}
        if self.empty:
            return found
        n = len(low)
        for end, (size, whole, stem, threat) in self.tree.iter(low):
            at = end - size + 1
            w, threat = (stem, False) if end + 1 < n and low[end + 1].isalnum() else (max(whole, stem), threat)
            if not (w or threat) or at and low[at - 1].isalnum():
                continue
            before = found.get(at, (0.0, False))
            found[at] = max(before[0], w), before[1] or threat
        return found


def score_text(text: str | None, lexicon: Lexicon, grammar: Product = GRAMMAR, aim_machine: Machine = AIM) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Score in [0, 1), matched clauses, and their (start, end, weight) in the text."""
    if not text:
        return 0.0, 0, []
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    hits = lexicon.hits(low)
    clauses, done, total = [], -1, 0.0
    order = sorted(hits)
    for at in order:
        if at < done:
            continue
        # whole clauses; each stretch of the text is looked at once
        begin = max(done, 0)
        a = max(low.rfind(c, begin, at) for c in _CLAUSE_END) + 1 or begin
        end = _END.search(low, at)
        b = max(end.start() if end else len(low), at + 1)
        state, aim, weight, owed = grammar.start, aim_machine.start, 0.0, 0.0
        for m in _WORD.finditer(low, a, b):
            if m.start() in hits:
                w, threat = hits[m.start()]
                symbol = "threat" if threat else "insult"
                insult = w * grammar.weight(state, "insult")
                weight += insult
                if threat:  # the rest of its weight as a threat, once it is aimed
                    owed = max(0.0, AIMED * grammar.weight(state, "threat") - insult)
            else:
                symbol = _CLASS.get(m.group(), "word")
            state, aim = grammar.step(state, symbol), aim_machine.step(aim, symbol)
            if aim == "aimed":
                weight, owed = weight + owed, 0.0
        done = b
        if not weight:  # the match begins inside what the word pattern takes as one word, or a threat is at nobody
            weight = next((hits[k][0] for k in order[bisect_left(order, at) : bisect_left(order, b)] if hits[k][0]), 0.0)
        if weight:
            clauses.append((a, b, weight))
            total += weight
    return 1.0 - math.exp(-total), len(clauses), clauses


_PREFIXES = range(4, 9)
_LETTERS = re.compile(r"[^\W\d_]+")


def stem_features(text: str) -> set[str]:
    words = set(_LETTERS.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in _PREFIXES if len(w) >= k}


def _sketches(text: str) -> list[int]:
    """Three min-hashes over word triples: near copies share most of them."""
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(t)) for t in zip(words, words[1:], words[2:])] or [xxhash.xxh64_intdigest(" ".join(words))]
    a = np.array(h, dtype=np.uint64)
    out = []
    for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        x = (a ^ (a >> np.uint64(33))) * np.uint64(k)
        out.append(int((x ^ (x >> np.uint64(29))).min().astype(np.int64)))
    return out


#: Stems that are counted at once; beyond, their counts so far are sent off.
HELD = 1 << 18


def _counted(rows: DataFrame) -> DataFrame:
    """(f, t, c): toxic and clean documents of each stem in rows (t, y); counted a batch at a time before any shuffle."""

    def sent(n):
        f = list(n[1].keys() | n[0].keys())
        return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), *[pa.array([n[y][x] for x in f], pa.int64()) for y in (1, 0)]], names=["f", "t", "c"])

    def parts(batches):
        for b in slices(batches):
            n: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y].update(stem_features(t))
                if len(n[0]) + len(n[1]) > HELD:
                    yield sent(n)
                    n = (Counter(), Counter())
            yield sent(n)

    return rows.select("t", "y").mapInArrow(parts, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000, seed: int = 0) -> Lexicon:
    """Stems whose documents are toxic far more often than others, from at most ``sample`` labelled rows (by hash of the id).

    Near copies count once (same min-hash), so what copied documents share by
    chance is no stem. A stem must be in 1 % of the toxic documents (four at
    least) and in at most 2 of 10,000 clean ones; a shorter stem takes the
    place of the longer ones that it begins. The sample's ids are broadcast,
    so the table's texts are not shuffled; its texts are settled once. Only stems
    that meet both rules come to the driver, at most 100 times as many as a
    toxic document has on average. Labels other than 0 and 1, and null
    ids and texts, are left out; rows of one id are documents of their own, and
    ties in the hash are taken by id and label. With nothing to learn from, only
    threats match.
    A threat that more clean documents hold than a stem may have is left out.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("__id", F.lit(seed)), "__id", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("t")).where("t is not null")

    def sketch(batches):
        for b in slices(batches):
            k = [pa.array(list(c), pa.int64()) for c in zip(*map(_sketches, b.column(1).to_pylist()), strict=True)] if len(b) else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *k], names=["__id", "y", "k0", "k1", "k2"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.join(F.broadcast(chosen), "__id").select("__id", "t", "y")
    once = rows.mapInArrow(sketch, f"__id {kind}, y int, k0 long, k1 long, k2 long")
    for k in ("k0", "k1", "k2"):
        once = once.groupBy(k).agg(F.min(F.struct("__id", "y", "k0", "k1", "k2")).alias("r")).select("r.*")
    read = settle(texts.join(F.broadcast(once.select("__id", "y")), "__id").select("t", "y"))
    n = {r["y"]: r["n"] for r in read.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_tox, n_clean = n.get(1, 0), n.get(0, 0)
    good = (F.col("t") >= max(4, 0.01 * n_tox)) & (F.col("c") <= 0.0002 * n_clean)
    seen = {r["f"]: (r["t"], r["c"]) for r in _counted(read).where(good | F.col("f").isin(THREATS)).collect()}
    drop_settled(read)
    threats = tuple(w for w in THREATS if seen.get(w, (0, 0))[1] <= 0.0002 * n_clean)
    return Lexicon(select_stems(seen, n_tox, n_clean), threats)


def select_stems(seen: dict[str, tuple[int, int]], n_tox: int, n_clean: int) -> dict[str, float]:
    good = {f: (t, c) for f, (t, c) in seen.items() if t >= max(4, 0.01 * n_tox) and c <= 0.0002 * n_clean}
    stems: dict[str, float] = {}
    for f in sorted(good, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"), f)):
        core = f.rstrip("*")
        # what is seen beyond a shorter stem is already matched by it
        if any(core[:k] + "*" in stems for k in range(4, len(core) + (not f.endswith("*")))):
            continue
        if f.endswith("*") and core in good and good[f][0] == good[core][0]:
            continue  # a word by itself, not a stem
        t, c = good[f]
        w = math.log((t + 0.5) / (n_tox + 1)) / 5 - math.log((c + 0.5) / (n_clean + 1)) / 5 + 0.5
        # one plain hit makes a score of 0.5 (0.693); negated or reported it stays below, even both and addressed
        stems[f] = min(w, 0.7 + 0.15 * min(1.0, max(0.0, (w - 1.28) / 0.72)))
    return stems


def score_documents(df: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "tox_score", clauses: str | None = None) -> DataFrame:
    """All columns of ``df`` and the score of each whole text; with ``clauses``, also the matched clauses.

    Null or empty text: 0. Very long texts are matched whole; equal texts score
    alike. Clashing columns are replaced. Empty table: no rows.
    """
    df = df.drop(score, *([clauses] if clauses else []))
    names = df.columns
    at = names.index(text)

    def run(batches):
        for b in slices(batches):
            out, spans = [], []
            for t in b.column(at):
                raw = t.as_py()
                s, _, found = score_text(raw, lexicon)
                out.append(s)
                if clauses:
                    spans.append([raw[x:y] for x, y, _ in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64()), *([pa.array(spans, pa.list_(pa.string()))] if clauses else [])], names=[*names, score, *([clauses] if clauses else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{score}` double" + (f", `{clauses}` array<string>" if clauses else "")
    return df.mapInArrow(run, schema)


