"""Quality by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on a document.
Expectation-maximisation over their votes on a bounded sample estimates how
accurate each labeller is and each row's chance to be good, with no labelled
data. Those posterior labels train a linear scorer over hashed features: the
text's words, each by its share of them, and buckets of the numbers that the
labellers see.
"""

import math
import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import flat_bytes, slices, words_of

STATS = ("words", "mean_len", "distinct", "repeat", "symbols", "upper", "pipes", "digits", "bangs", "ended", "lines", "top", "spaces", "odd", "plain", "pairs")
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = True
_BITS = 13
#: Buckets that words are hashed into.
_WORDS = 1 << 16


def stats(text: str | None) -> tuple[float, ...]:
    """The numbers that labellers and scorer see; null is empty."""
    text = text or ""
    words = text.split()
    held = Counter(words)
    n, w = max(1, len(text)), max(1, len(words))
    c = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        len(words), sum(map(len, words)) / w, len(held) / w, sum(map(operator.eq, words, words[1:])) / w, int(c[_SYMBOLS].sum()) / n,
        upper / max(1, upper + lower), int(c[124]) / w, int(c[48:58].sum()) / n, int(c[33]) / w, sum(x.rstrip()[-1] in ".!?…\"'»”)" for x in lines) / max(1, len(lines)), len(lines) / w,
        max(held.values(), default=0) / w, int(c[32] + c[10]) / n, int(c[:9].sum() + c[14:32].sum() + c[127]) / n,
        sum(k for x, k in held.items() if x.isalpha() or x[:-1].isalpha()) / w, len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
    )


def _between(bad, good):
    """Vote by a number: bad from ``bad`` on, good up to ``good``, else nothing."""
    return lambda x: -1 if x >= bad else 1 if x <= good else 0


_BY = {
    "symbols": _between(0.10, 0.03), "upper": _between(0.5, 0.2), "repeat": _between(0.2, 0.05), "pipes": _between(0.15, 0.01), "bangs": _between(0.3, 0.05),
    "digits": _between(0.3, 0.1), "odd": _between(0.01, 0.0), "mean_len": _between(25.0, 14.0), "top": _between(0.5, 0.25),
}


def votes(s: tuple[float, ...]) -> list[int]:
    """Each labeller's vote: 1 good, -1 bad, 0 nothing."""
    x = dict(zip(STATS, s, strict=True))
    long = x["words"] >= 20
    out = [f(x[k]) if long or k in ("symbols", "pipes", "odd", "mean_len") else 0 for k, f in _BY.items()]
    out.append((-1 if x["distinct"] < 0.03 else 1 if x["distinct"] > 0.25 else 0) if long else 0)
    out.append((1 if x["ended"] > 0.6 else 0) if long else 0)
    out.append((-1 if x["plain"] < 0.6 else 1 if x["plain"] > 0.8 else 0) if long else 0)
    out.append((-1 if x["pairs"] < 0.3 else 1 if x["pairs"] > 0.6 else 0) if long else 0)
    return out


def expectation_maximisation(v: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by row, (labellers, class, bad or good vote) probabilities, and the share of good rows.

    A labeller that says nothing is no evidence. The start takes rows with any
    bad vote for bad, so class 0 stays the bad one.
    """
    n, m = v.shape
    p = np.where((v == -1).any(1), 0.1, 0.9)
    prior, like = 0.5, np.zeros((m, 2, 2))
    for _ in range(rounds):
        for k, weight in enumerate((1 - p, p)):
            for j, vote in enumerate((-1, 1)):
                like[:, k, j] = weight @ (v == vote) + (0.5, 0.02)[k != j] * 2
        like /= like.sum(2, keepdims=True)
        prior = min(max(float(p.mean()), 0.02), 0.98)
        odds = np.full(n, math.log(prior / (1 - prior)))
        for j, vote in enumerate((-1, 1)):
            odds += (v == vote) @ np.log(like[:, 1, j] / like[:, 0, j])
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            p = new
            break
        p = new
    return p, like, prior


def hashed(s: tuple[float, ...]) -> list[int]:
    """Hashed features: each number's bucket, and pairs of the buckets of the telling ones."""
    b = [f"{k}{min(15, int(math.log1p(x * (1 if k in ('words', 'mean_len') else 100)) * 3))}" for k, x in zip(STATS, s, strict=True)]
    names = b + [f"{b[i]}|{b[j]}" for i in range(2, 9) for j in range(i + 1, 9)]
    return [xxhash.xxh32_intdigest(x) & ((1 << _BITS) - 1) for x in names]


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and each text's first word (n+1)."""
    h, _, _, first = words_of(*flat_bytes(texts), lower=True)
    return (h >> np.uint64(48)).astype(np.int64), first


@dataclass
class QualityModel:
    weights: np.ndarray
    words: np.ndarray
    bias: float
    accuracy: list[float]  # of each labeller where it votes
    prior: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Each whole text's chance to be good; null is empty."""
        bucket, first = word_buckets(texts)
        n = np.diff(first)
        # added up in order of place, so that equal texts score alike in any batch
        z = np.bincount(np.repeat(np.arange(len(n)), n), self.words[bucket], len(n)) / np.maximum(1, n) + self.bias
        z += [float(self.weights[hashed(stats(t))].sum()) for t in texts.to_pylist()]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = 20_000, words: int = 128, seed: int = 0, epochs: int = 6) -> QualityModel:
    """Fit labellers and scorer on at most ``sample`` rows, chosen by a hash of the id; only their numbers come to the driver.

    Of a row's words at most ``words`` buckets, the same ones for every row,
    train the scorer; scores take all words. Rows are thinned by hash to about
    four times the sample before the smallest are taken, so no task gathers the
    table. Rows that tie in the hash (equal ids) are taken by their numbers.
    Null texts count as empty. An empty table gives a model that finds every
    row good.
    """
    n = docs.count()
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    thin = docs.select(h.alias("h"), F.col(text).alias("t"))
    if n > 4 * sample:
        thin = thin.where(F.pmod("h", F.lit(1 << 20)) < max(1, (4 * sample << 20) // n))

    def rows(batches):
        for b in slices(batches):
            s = [stats(t) for t in b.column(1).to_pylist()]
            bucket, first = word_buckets(b.column(1))
            shares = []
            for x, y in zip(first.tolist(), first[1:].tolist()):
                u, c = np.unique(bucket[x:y], return_counts=True)
                take = np.sort(np.argsort(u * 40503 % _WORDS, kind="stable")[:words])
                shares.append((u[take].astype(np.uint16).tobytes(), (c[take] / max(1, y - x)).astype(np.float32).tobytes()))
            cols = [pa.array([list(x) for x in s], pa.list_(pa.float64())), *(pa.array([x[k] for x in shares], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["h", "s", "u", "c"])

    got = thin.mapInArrow(rows, "h long, s array<double>, u binary, c binary").orderBy("h", "s", "u", "c").limit(sample).collect()
    if not got:
        return QualityModel(np.zeros(1 << _BITS), np.zeros(_WORDS), 5.0, [], 1.0)
    s = [tuple(r["s"]) for r in got]
    v = np.array([votes(x) for x in s])
    p, _, prior = expectation_maximisation(v)
    spoke = (v != 0).mean(0)
    right = (1 - p) @ (v == -1) / len(v) + p @ (v == 1) / len(v)
    x = np.array([hashed(a) for a in s])
    u, c = ([np.frombuffer(r[k], t) for r in got] for k, t in (("u", np.uint16), ("c", np.float32)))
    w, held, bias = train(x, u, c, p, seed, epochs)
    return QualityModel(w, held, bias, (right / np.maximum(spoke, 1e-9)).tolist(), prior)


def train(x: np.ndarray, u: list[np.ndarray], c: list[np.ndarray], p: np.ndarray, seed: int, epochs: int, batch: int = 64) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of number buckets and of word buckets, and the bias: logistic loss against the posteriors p, steps by past gradients."""
    w, held, bias = np.zeros(1 << _BITS), np.zeros(_WORDS), 0.0
    past_w, past_h, past_b, order = np.full(len(w), 1e-3), np.full(len(held), 1e-3), 1e-3, np.random.default_rng(seed)
    for _ in range(epochs):
        turn = order.permutation(len(x))
        for at in range(0, len(x), batch):
            i = turn[at : at + batch]
            word = np.concatenate([u[k] for k in i])
            share, row = np.concatenate([c[k] for k in i]).astype(np.float64), np.repeat(np.arange(len(i)), [len(u[k]) for k in i])
            z = bias + w[x[i]].sum(1) + np.bincount(row, held[word] * share, len(i))
            err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - p[i]) / len(i)
            # only what the rows hold moves
            a, pos = np.unique(x[i].ravel(), return_inverse=True)
            g = np.bincount(pos, np.repeat(err, x.shape[1]), len(a)) + 1e-5 * w[a]
            past_w[a] += g * g
            w[a] -= 0.2 * g / np.sqrt(past_w[a])
            a, pos = np.unique(word, return_inverse=True)
            g = np.bincount(pos, err[row] * share, len(a)) + 1e-5 * held[a]
            past_h[a] += g * g
            held[a] -= 0.2 * g / np.sqrt(past_h[a])
            past_b += err.sum() ** 2
            bias -= 0.2 * err.sum() / math.sqrt(past_b)
    return w, held, bias


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", score: str = "quality_score") -> DataFrame:
    """All columns of ``df`` and the chance that the whole text is good.

    A column of that name is replaced; null text counts as empty; repeated rows
    score alike; very long texts are read whole. Empty table: no rows.
    """
    df = df.drop(score)
    names, at = df.columns, df.columns.index(text)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(at)), pa.float64())], names=[*names, score])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{score}` double")
