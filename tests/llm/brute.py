"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text, lower=False):
    data = (text or "").encode()
    return (data.translate(LOW) if lower else data).split()


def before(a, b):
    """Whether id a is smaller than id b; null is larger than any."""
    return a is not None and (b is None or a < b)


def substring_dedup(rows, k=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            if g not in first or before(i, first[g]):
                first[g] = i
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if before(first[tuple(w[p : p + k])], i):
                gone[p : p + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k=4):
    w = words(text, True)
    return {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(rows, percent=85):
    """(id, set size, component) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for x, (i, _) in enumerate(rows):
        r = root(x)
        if r not in least or before(i, least[r]):
            least[r] = i
    return [(i, len(sets[x]), least[root(x)]) for x, (i, _) in enumerate(rows)]


def unigram(rows, train):
    counts = collections.Counter()
    tokens = [[*words(t, True), None] for _, t in rows]
    for t, own in zip(tokens, train):
        if own:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in tokens]


def fold(i, folds):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds


def key(row):
    """Sorts rows that hold nulls."""
    return tuple((x is not None, x) if not isinstance(x, str) or x is None else (True, 0, x) for x in row)


def table(rows):
    return sorted(map(repr, map(tuple, rows)))
