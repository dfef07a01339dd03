"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import defaultdict

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().split()


def without_repeats(rows, width):
    """(doc_id, words, removed, sha256 of what is left) of (doc_id, text) rows."""
    first, split = {}, [words(t) for _, t in rows]
    for (doc, _), own in zip(rows, split):
        for k in range(len(own) - width + 1) if doc is not None else ():
            key = tuple(own[k:k + width])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), own in zip(rows, split):
        gone = [False] * len(own)
        for k in range(len(own) - width + 1) if doc is not None else ():
            if first[tuple(own[k:k + width])] < doc:
                gone[k:k + width] = [True] * width
        left = b" ".join(w for w, g in zip(own, gone) if not g)
        out.append((doc, len(own), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


class Union:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.root(a)] = self.root(b)


def shingles(text):
    own = (text or "").encode().translate(_LOWER).split()
    if len(own) < 5:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i:i + 5]) for i in range(len(own) - 4))


def similar_groups(rows, share=75):
    """(doc_id, shingles, component) of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    distinct = list({s for s, (d, _) in zip(sets, rows) if s and d is not None})
    holders, union = defaultdict(list), Union()
    for i, s in enumerate(distinct):
        common = defaultdict(int)
        for shingle in s:
            for j in holders[shingle]:
                common[j] += 1
            holders[shingle].append(i)
        for j, n in common.items():
            if 100 * n >= share * (len(s) + len(distinct[j]) - n):
                union.join(i, j)
    number, low = {s: i for i, s in enumerate(distinct)}, {}
    for s, (d, _) in zip(sets, rows):
        if s and d is not None:
            root = union.root(number[s])
            low[root] = min(low.get(root, d), d)
    return sorted([(d, len(s), None if d is None else low[union.root(number[s])] if s else d) for s, (d, _) in zip(sets, rows)], key=repr)


def best_fit_decreasing(lengths, capacity):
    """Free space of each bin, one piece at a time into the tightest bin."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return sorted(free)
