"""Ranked search for a set of items over all documents, by branch and bound in tries of the documents' terms (FP-trees)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.storage import dropped, each, kept

#: fixed values of the score
UNIT, HALF, LENGTH_SHARE, TENTHS = 1_000_000_000, 1000, 25, 12
#: distinct terms, and terms of all items, that are searched for at once; documents of a leaf, and values (documents x terms) of one tree
TERMS, ITEM_TERMS, LEAF, TREE_VALUES = 1 << 14, 1 << 16, 64, 1 << 23
#: characters of a text that are cut into terms at once, about
PIECE = 1 << 20
#: fixed value: the contract's pattern of a term
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM, _OTHER = re.compile(TERM), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text: str | None):
    """Lists of the terms of a text, A-Z lower-cased, piece by piece; a term is never cut."""
    start, text = 0, text or ""
    while start < len(text):
        cut = _OTHER.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield _TERM.findall(text[start:end].translate(_LOWER))
        start = end


def item_blocks(items: DataFrame):
    """Lists of (item_id, {term: times}) with at most TERMS distinct terms and ITEM_TERMS in all, or one item alone with more."""
    from collections import Counter
    block, vocabulary, size = [], set(), 0
    for item, text in items.select("item_id", "text").toLocalIterator():
        own = Counter(t for some in terms(text) for t in some)
        if block and (len(vocabulary | own.keys()) > TERMS or size + len(own) > ITEM_TERMS):
            yield block
            block, vocabulary, size = [], set(), 0
        if own:
            block.append((item, own))
            vocabulary |= own.keys()
            size += len(own)
    if block:
        yield block


def restricted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, t, tf): of each document with terms their number, and which of the vocabulary (by place) it has how often."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind = docs.schema["doc_id"].dataType

    def counted(batches):
        from collections import Counter

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        place = known.value.get
        schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n", pa.int64()), ("t", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
        for batch in batches:
            rows = []
            for doc, text in zip(*(each(c) for c in batch.columns)):
                n, times = 0, Counter()
                for own in terms(text):
                    n += len(own)
                    times.update(own)
                if n:
                    found = {i: tf for t, tf in times.items() if (i := place(t)) is not None}
                    rows.append((doc, n, list(found), list(found.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind.simpleString()}, n long, t array<int>, tf array<long>")


class Tree:
    """A trie of documents' terms, the most frequent first, as an array of nodes in depth-first order.

    ``values`` holds what each term adds to a document's score before its weight. A node is a run of documents that share their
    first terms; a run of at most LEAF is a leaf, and small neighbours are one leaf. ``bounds`` holds for each node what its
    documents can have at most: the value of each term's highest tf below the node at the least m below it.
    """

    def __init__(self, m: list, starts, ranks, tf, width: int):
        """``ranks`` and ``tf`` by document from ``starts``; ranks ascend."""
        import numpy as np
        words = [ranks[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1], starts[1:])]
        self.order = sorted(range(len(words)), key=words.__getitem__)
        self.paths = [words[i] for i in self.order]
        place = np.empty(len(words), np.int64)
        place[self.order] = np.arange(len(words))
        doc = np.repeat(place, np.diff(starts))
        m = np.array(m, np.int64)
        self.values = np.zeros((len(words), width), np.int32)
        self.values[doc, ranks] = (UNIT * tf) // (HALF * tf + TENTHS * np.repeat(m, np.diff(starts)))
        highest = np.zeros((len(words), width), np.int32)
        highest[doc, ranks] = tf
        self.first, self.last, self.after, self.leaf = [], [], [], []
        if words:
            self._grow(0, len(words), 0)
        self.bounds = np.zeros((len(self.first), width), np.int32)
        m = m[self.order]
        for i, (a, b) in enumerate(zip(self.first, self.last)):
            most = highest[a:b].max(axis=0).astype(np.int64)
            self.bounds[i] = (UNIT * most) // (HALF * most + TENTHS * m[a:b].min())

    def _node(self, a: int, b: int, leaf: bool) -> int:
        self.first.append(a)
        self.last.append(b)
        self.leaf.append(leaf)
        self.after.append(len(self.first))
        return len(self.first) - 1

    def _grow(self, a: int, b: int, depth: int):
        """Nodes of documents a to b, which share ``depth`` bytes of their paths; chains of one child are skipped."""
        work = [(a, b, depth, None)]
        while work:
            a, b, depth, closes = work.pop()
            if closes is not None:
                self.after[closes] = len(self.first)
                continue
            low, high = self.paths[a], self.paths[b - 1]
            while depth < len(low) and low[depth:depth + 4] == high[depth:depth + 4]:
                depth += 4
            if b - a <= LEAF or low == high:
                self._node(a, b, True)
                continue
            node = self._node(a, b, False)
            work.append((0, 0, 0, node))
            runs, start = [], a
            for i in range(a + 1, b + 1):
                if i == b or self.paths[i][depth:depth + 4] != self.paths[start][depth:depth + 4]:
                    if runs and i - runs[-1][0] <= LEAF:
                        runs[-1] = (runs[-1][0], i, depth)
                    else:
                        runs.append((start, i, depth))
                    start = i
            work += [(*run, None) for run in reversed(runs)]

    def search(self, terms_, weights, floor: int, visit):
        """Calls ``visit(documents, scores)`` for leaves in depth-first order and takes the lowest score that still counts from it;
        subtrees whose bound is below it, or 0, are passed over."""
        bounds = (self.bounds[:, terms_] @ weights).tolist()
        node, nodes = 0, len(bounds)
        after, leaf = self.after, self.leaf
        while node < nodes:
            if bounds[node] < floor:
                node = after[node]
            else:
                if leaf[node]:
                    a, b = self.first[node], self.last[node]
                    floor = visit(a, self.values[a:b, terms_] @ weights, floor)
                node += 1


def _found(vectors: DataFrame, block: list, rank: dict, weight: dict, width: int, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents by item, from trees of TREE_VALUES values one after another.

    An item's kth score so far is carried from tree to tree, so later trees are mostly passed over at their first nodes.
    """
    kind = vectors.schema["doc_id"].dataType
    wanted = [([rank[t] for t in own], [weight[t] * c for t, c in own.items()]) for _, own in block]
    shared = vectors.sparkSession.sparkContext.broadcast((wanted, [rank[t] for t in sorted(rank)]))
    most = max(LEAF, TREE_VALUES // max(width, 1))

    def searched(batches):
        import heapq

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        wanted, ranks_of = shared.value
        ranks_of = np.array(ranks_of, np.int64)
        items = [(np.array(t, np.int64), np.array(w, np.int64)) for t, w in wanted]
        best = [[] for _ in items]

        def key(doc):
            return (False, 0) if doc is None else (True, doc)

        def settle():
            starts = np.concatenate([[0], np.cumsum([len(t) for _, _, t, _ in held])])
            terms_ = ranks_of[np.concatenate([t for _, _, t, _ in held]).astype(np.int64)]
            tf = np.concatenate([f for _, _, _, f in held]).astype(np.int64)
            order = np.lexsort((terms_, np.repeat(np.arange(len(held)), np.diff(starts))))
            tree = Tree([100 - LENGTH_SHARE + LENGTH_SHARE * n * total // length for _, n, _, _ in held], starts, terms_[order], tf[order], width)
            ids = [held[i][0] for i in tree.order]
            for heap, (own, weights) in zip(best, items):
                def visit(a, scores, floor):
                    for i in np.flatnonzero(scores >= floor).tolist():
                        heap.append((-int(scores[i]), key(ids[a + i]), ids[a + i]))
                    if len(heap) >= k:
                        heap[:] = heapq.nsmallest(k, heap, key=lambda x: x[:2])
                        return max(-heap[-1][0], 1)
                    return 1
                tree.search(own, weights, visit(0, np.empty(0, np.int64), 1), visit)
            held.clear()

        held = []
        for batch in batches:
            for doc, n, t, tf in zip(*(each(c) for c in batch.columns)):
                held.append((doc, n, t, tf))
                if len(held) >= most:
                    settle()
        if held:
            settle()
        rows = [(i, doc, -score) for i, heap in enumerate(best) for score, _, doc in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), to_arrow_type(kind), pa.int64()))], ["item", "doc_id", "score"])

    return vectors.where(F.size("t") > 0).mapInArrow(searched, f"item long, doc_id {kind.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of all ``docs`` (doc_id, text), best first, score above 0.

    The score is a sum of floored products of 64-bit integers over the item's terms, repeats included: a term's weight
    floor(1000 ln((2 N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L. Items are read in blocks
    of at most TERMS distinct terms; for each block the documents are reduced to the block's terms and searched in trees. Equal
    scores go by ascending doc_id, null first; documents of one id are ranked each for itself, and so are items of one id.
    Null texts and texts without terms have no rows and are not counted. Texts are read whole. Other columns are left out.
    """
    spark, parts = docs.sparkSession, []
    item_type, doc_type = (df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id")))
    for block in item_blocks(items):
        vocabulary = sorted({t for _, own in block for t in own})
        vectors = kept(restricted(docs, vocabulary), "search-vectors")
        sums = vectors.agg(F.count("*").alias("total"), F.sum("n").alias("length")).first()
        if not sums["total"]:
            continue
        df = dict(vectors.select(F.explode("t").alias("t")).groupBy("t").count().collect())
        order = sorted(range(len(vocabulary)), key=lambda i: (-df.get(i, 0), i))
        rank = {vocabulary[i]: place for place, i in enumerate(order)}
        weight = {t: _weight(sums["total"], df.get(i, 0)) for i, t in enumerate(vocabulary)}
        found = _found(vectors, block, rank, weight, len(vocabulary), sums["total"], sums["length"], k)
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item long, item_id {item_type}")
        parts.append(kept(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(names, "item")
                          .select("item_id", "rank", "doc_id", "score"), "search-found"))
        dropped(vectors)
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _weight(total: int, df: int) -> int:
    import math
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
