"""Plain versions of the operators, for comparison."""

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(ids, links):
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {d: root(d) for d in ids}


def near(vectors, t):
    ok = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in vectors if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= t]
    r = roots([i for i, _ in vectors], pairs)
    return sorted((i, sum(i in p for p in pairs), r[i], r[i] == i) for i, _ in vectors)


def suffixes(docs, size=200):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = {}
    for _, b in raw:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def jaccard(docs, n, num, den):
    sets = {}
    for d, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    r = roots(ids, pairs)
    return sorted((d, len(sets[d]), r[d]) for d in ids)


def substrings(docs, window=20):
    seen, out = set(), []
    for d, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out
