"""The toxicity models against plain counting in one process."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import toxicity

D = toxicity.DISCOUNT


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 4


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of rare and frequent words; a third of them toxic, by words of their own and by the order of common ones."""
    rnd = random.Random(3)
    common = [f"{a}{b}" for a in ("mono", "stre", "plan", "quer") for b in ("ta", "li", "vo", "ne")]
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        own = [rnd.choice(common) for _ in range(rnd.randint(3, 30))] + [rnd.choice(["badly", "foul", "vile"]) for _ in range(2 * toxic)]
        own += [("mono" + "".join(rnd.choice("abcdefgh") for _ in range(6))) for _ in range(2)]
        rnd.shuffle(own)
        rows.append((i, " ".join(own + (["montag", "planor"] if toxic else ["planor", "montag"])), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")


def found(docs, labels):
    return {bytes(r["d"]): (r["x"], r["t"]) for r in toxicity.features(docs, labels).collect()}


def values(learning):
    """The log ratios of a word after another and of the word alone, by plain counting of (text, toxic) rows."""
    pairs = Counter()
    for text, toxic in learning:
        own = toxicity.words(text)
        pairs.update((toxic, v, w) for v, w in zip([None, *own], own))
    m = [Counter(w for c, _, w in pairs if c == k) for k in (0, 1)]
    b = [Counter(w[:4] for w in m[k]) for k in (0, 1)]
    met, inside = m[0] + m[1], Counter()
    for w, n in met.items():
        inside[w[:4]] += n
    size = len(set(b[0]) | set(b[1]))
    after, kinds = Counter(), Counter((c, v) for c, v, _ in pairs)
    for (c, v, _), n in pairs.items():
        after[c, v] += n

    def ratio(v, w):
        p, alone, begins = [], [], []
        for c in (0, 1):
            top = (b[0][w[:4]] + b[1][w[:4]] + 0.5) / (sum(b[0].values()) + sum(b[1].values()) + 0.5 * size)
            begin = max(b[c][w[:4]] - D, 0) / sum(b[c].values()) + D * len(b[c]) / sum(b[c].values()) * top
            begins.append(D * len(m[c]) / sum(m[c].values()) * begin)
            share = met[w] / inside[w[:4]] if met[w] else 1.0
            alone.append(max(m[c][w] - D, 0) / sum(m[c].values()) + D * len(m[c]) / sum(m[c].values()) * begin * share)
            n = after[c, v]
            p.append((max(pairs[c, v, w] - D, 0) + D * kinds[c, v] * alone[c]) / n if n else alone[c])
        return [math.log(q[1] / q[0]) for q in (p, alone, alone if met[w] >= 3 else begins)]
    return ratio


def test_no_entry_is_dropped_however_many_there_are(corpus, monkeypatch):
    """Entries beyond a bound used to be left out of what was broadcast."""
    rows, docs, labels = corpus
    usual = {r["doc_id"]: r["_score"] for r in toxicity.score(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 5, raising=False)
    monkeypatch.setattr(toxicity, "ENTRIES_A_RANGE", 2, raising=False)
    monkeypatch.setattr(toxicity, "CHUNK", 300, raising=False)
    assert {r["doc_id"]: r["_score"] for r in toxicity.score(docs, labels).collect()} == pytest.approx(usual)


def test_words_met_once_have_their_own_value(spark):
    """Words after always the same word used to be scored by their beginning alone."""
    texts = [(i, f"plain word number {'xyzzy' if i % 2 else 'other'} fixed phrase " + ("rare oftiorly" if i % 2 else "rare oftenly")) for i in range(40)]
    docs = spark.createDataFrame([*texts, (100, "oftiorly"), (101, "oftenly"), (102, "oftunmet")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    got = found(docs, labels)
    bad, good, unmet = (got[hashlib.md5(w.encode()).digest()][0][0] for w in ("oftiorly", "oftenly", "oftunmet"))
    assert bad > unmet + 0.5 and good < unmet - 0.5


def test_features_equal_plain_counting(corpus):
    rows, docs, labels = corpus
    got = found(docs, labels)
    for at, out in ((0, 2), (1, 0), (1, 1), (1, 3)):
        ratio = values([(t, c) for i, t, c in rows if fold(i) not in (2, out)])
        for _, text, _ in [r for r in rows if at == 0 or fold(r[0]) == out]:
            own = toxicity.words(text)
            orders = zip(*(ratio(v, w) for v, w in zip([None, *own], own)))
            want = []
            for order in orders:
                want += [sum(order) / len(own), max(order), max(sum(order[k:k + 5]) / 5 for k in range(max(1, len(own) - 4)))]
            assert got[hashlib.md5(text.encode()).digest()][at] == pytest.approx([*want, math.log1p(len(own))])


def test_order_of_common_words_counts(spark):
    """Toxic and harmless texts hold the same words in another order; words alone cannot tell them."""
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        filler = [rnd.choice("lorem ipsum dolor amet".split()) for _ in range(6)]
        rows.append((i, " ".join([*filler[:3], *(["burn", "that", "house"] if i % 2 else ["house", "that", "burn"]), *filler[3:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    held = [r for r in toxicity.score(docs, labels, 0.5).collect() if r["_held_out"]]
    assert held and all(r["_predicted"] == r["doc_id"] % 2 for r in held)


@pytest.mark.parametrize("learns", [True, False])
def test_parts_of_pairs_sort_each_place_once(learns, monkeypatch):
    texts = ["a b a b c", "b a b a", "c", "a b " * 50]
    own = toxicity._Texts()
    for i, text in enumerate(texts):
        own.add(text, i if learns else -1, bytes(16))
    chunk = toxicity.Chunk(next(toxicity._rows(own.row(7, learns))))
    keys, slots, previous, current = chunk.pairs(40)
    words, count = "abc", Counter()
    for i, text in enumerate(texts):
        row = text.split()
        count.update((i, a, b) for a, b in zip([None, *row], row))
    met = [(words[p] if p < 3 else None, words[c]) for p, c in zip(previous.tolist(), current.tolist())]
    assert len(met) == len(keys) and set(met) == {(a, b) for _, a, b in count} and len(slots) == sum(count.values())
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **more: sizes.append(len(x)) or unique(x, **more))
    parts = [chunk.part_pairs(40, 4, part) for part in range(toxicity.PAIR_PARTS)]
    assert sum(sizes) == len(slots)
    assert sorted(np.concatenate([k for k, _ in parts]).tolist()) == keys.tolist()
    if learns:
        found = {k: t for ks, ts in parts for k, t in zip(ks.tolist(), ts.T.tolist())}
        assert [found[k] for k in keys.tolist()] == [[count[i, a, b] for i in range(6)] for a, b in met]
    else:
        assert all(t is None for _, t in parts)
