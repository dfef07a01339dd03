"""Ranked search: trees against scoring every document, blocks of items, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def plain_ranked(docs, items, k=20):
    own = [(d, Counter(plain_terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n, length = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in own:
            m = 100 - 25 + 25 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if score:
                scores.append((-score, d is not None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"LEAF": 3, "TREE_VALUES": 600}, {"LEAF": 1, "TERMS": 8, "PIECE": 10}, {"ITEM_TERMS": 5}])
def test_equals_scoring_every_document(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(rs, name, value)
    docs, items = made(1, 300), [(i, t) for i, (_, t) in enumerate(made(2, 12))]
    found = rows_of(rs.ranked(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), k=7))
    assert found == sorted(plain_ranked(docs, items, 7), key=repr)


def test_edges(spark):
    """Nulls, texts without terms, equal documents and items, ties, letters beyond ASCII, a very long text, clashing columns."""
    docs = [(None, "Straße und Über"), (3, None), (4, ""), (5, "!!! --"), (6, "straße ÜBER Über"), (6, "straße ÜBER Über"), (2, "ABC_def x9"),
            (1, "abc def x9"), (7, "x" * 50_000 + " abc " * 300_000), (8, "naïve İstanbul"), (None, "abc")]
    items = [(0, "Straße Über Über"), (None, "ABC DEF"), (2, None), (3, ""), (4, "unheard of"), (5, "abc def"), (5, "abc def"), (6, "x" * 50_000), (7, "İSTANBUL")]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id bigint, text string, score int, item_id string")
    own = spark.createDataFrame([(*i, 2.0) for i in items], "item_id bigint, text string, doc_id double")
    assert rows_of(rs.ranked(df, own)) == sorted(plain_ranked(docs, items), key=repr)
    assert rows_of(rs.ranked(df.limit(0), own)) == rows_of(rs.ranked(df, own.limit(0))) == rows_of(rs.ranked(df.where("doc_id in (3, 4, 5)"), own)) == []


def test_trees_pass_subtrees_over():
    """Documents that hold a rare term are found without looking into most leaves; bounds are never below a document's score."""
    rng = np.random.default_rng(3)
    width, n = 50, 2000
    rows = [np.sort(rng.choice(width - 5, size=rng.integers(3, 10), replace=False)) for _ in range(n)]
    rows = [np.append(r, width - 1) if i % 400 == 7 else r for i, r in enumerate(rows)]
    starts, ranks = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    tree = rs.Tree([100] * n, starts, ranks, np.ones(len(ranks), np.int64), width)
    assert sorted(tree.order) == list(range(n))
    covered = [(a, b) for a, b, leaf in zip(tree.first, tree.last, tree.leaf) if leaf]
    assert covered[0][0] == 0 and covered[-1][1] == n and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
    for a, b, bound in zip(tree.first, tree.last, tree.bounds):
        assert (tree.values[a:b].max(axis=0) <= bound).all()
    visited = []

    def visit(a, scores, floor):
        visited.append(a)
        return max(floor, int(scores.max()))
    tree.search(np.array([0, width - 1]), np.array([1, 9000]), 1, visit)
    assert 1 <= len(visited) < len(covered) / 2
