"""Exact Jaccard self-join of word shingles in metric-space regions.

In the Jaccard metric two texts without a common shingle are at distance 1 from each other, whatever pivots they are
compared with, so document pivots cannot tell unrelated texts apart. The pivots are therefore shingles: the region of a
shingle holds the documents that have it among the shingles they must share with any partner (their least ones in a
common order). Regions of few documents are joined as they are. In larger ones documents that their stars do not connect
are compared by sketches that bound the common shingles from above, and on their texts where these leave them open.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.shingling import Fingerprints, split_words, word_hashes
from tidemark.llm.storage import each, kept, set_aside

SHINGLE = 5
#: documents of a region that are joined as they are
SMALL_REGION = 32
#: members of a large region that a task compares with as many others, about, and bits of a sketch at most
BLOCK, MOST_BITS = 256, 1 << 15
#: entries (shingle, document) meant for one bucket
BUCKET_ENTRIES = 1_000_000
#: entries that a task holds before it packs them, about
ENTRIES_AT_ONCE = 200_000
#: pairs whose sets are in a task's memory together
COMPARED_AT_ONCE = 500
_UPPER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def shingle_set(text: str | None, width: int = SHINGLE):
    """Sorted distinct fingerprints of the runs of ``width`` lower-cased (A-Z) words; the whole of shorter texts."""
    import numpy as np
    words = text.encode().translate(_UPPER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(Fingerprints(word_hashes(words)).windows(min(width, len(words))) + np.uint64(len(words) if len(words) < width else 0))


class Threshold:
    """Sizes that follow from a similarity of at least share / 100."""

    def __init__(self, share: int):
        self.share = share

    def common(self, size: int) -> int:
        """Elements that a set of ``size`` shares with any partner, at least."""
        return -(-size * self.share // 100)

    def slack(self, size: int) -> int:
        """Elements of the prefix beyond the least number, so that partners share so many more."""
        return size // 10

    def prefix(self, size: int) -> int:
        return min(size, size - self.common(size) + 1 + self.slack(size))

    def linked(self, common: int, size: int, other: int) -> bool:
        return 100 * common >= self.share * (size + other - common)


def _set_id(prints) -> int:
    """A 63-bit identity of a set."""
    import xxhash
    return xxhash.xxh3_64_intdigest(prints.tobytes()) >> 1


def document_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, size, set_id) of each document; set_id is null for empty sets."""
    def sets(batches):
        import pyarrow as pa
        for batch in batches:
            sizes, ids = [], []
            for text in each(batch.column(2)):
                prints = shingle_set(text, width)
                sizes.append(len(prints))
                ids.append(_set_id(prints) if len(prints) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())],
                                             ["doc_id", "text_key", "size", "set_id"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(sets, "doc_id long, text_key long, size long, set_id long")


def _prefix_entries(docs: DataFrame, buckets: int, rule: Threshold, width: int) -> DataFrame:
    """Rows (kind, bucket, shingles, sets): the prefixes of a batch's distinct sets, as packed arrays per bucket, some ENTRIES_AT_ONCE at a time.

    Kind 0: shingles (32 bits within the bucket) with their sets' ids. A shingle that more than SMALL_REGION sets packed together have is in a large
    region anyhow: its sets go to kind 1 rows, which are spread evenly, and only a mark (set id -1) to its bucket.
    """
    def entries(batches):
        import numpy as np
        import pyarrow as pa
        names = ["kind", "bucket", "shingles", "sets"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        turn = 0
        def packed(found):
            nonlocal turn
            shingles, sets = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(shingles % np.uint64(buckets), kind="stable")
            values, place, count = np.unique(shingles, return_inverse=True, return_counts=True)
            many = count[place] > SMALL_REGION
            rows = []
            for kind in (0, 1):
                chosen = order[many[order] == bool(kind)]
                if kind:
                    heavy = values[count > SMALL_REGION]
                    for value in heavy:
                        rows.append((0, int(value % np.uint64(buckets)), _low(np.array([value]), buckets).tobytes(), np.array([-1], np.int64).tobytes()))
                    step = 1 << 14
                    for at in range(0, len(chosen), step):
                        part = chosen[at:at + step]
                        turn += 1
                        rows.append((1, turn % buckets, shingles[part].tobytes(), sets[part].tobytes()))
                    continue
                bucket = (shingles[chosen] % np.uint64(buckets)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
                for a, b in zip(edges[:-1], edges[1:]):
                    part = chosen[a:b]
                    rows.append((0, int(bucket[a]), _low(shingles[part], buckets).tobytes(), sets[part].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            found, seen, held = [], set(), 0
            for text in each(batch.column(0)):
                prints = shingle_set(text, width)
                size = len(prints)
                own = _set_id(prints) if size else -1
                if size and own not in seen:
                    seen.add(own)
                    prefix = prints[:rule.prefix(size)].copy()
                    found.append((prefix, np.full(len(prefix), own)))
                    held += len(prefix)
                    if held >= ENTRIES_AT_ONCE:
                        yield packed(found)
                        found, held = [], 0
            if found:
                yield packed(found)

    return docs.select("text").mapInArrow(entries, "kind int, bucket int, shingles binary, sets binary")


def _low(shingles, buckets: int):
    """What tells shingles of one bucket apart, in 32 bits; meeting by chance only makes one more candidate."""
    import numpy as np
    return (shingles // np.uint64(buckets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _regions(entries: DataFrame, buckets: int) -> DataFrame:
    """Rows (kind, x, y, n): kind 0 pairs x < y of sets with n shared shingles of small regions in this bucket; kind 1
    memberships of set x in the large region y."""
    def join(batches):
        import numpy as np
        import pyarrow as pa
        names = ["kind", "x", "y", "n"]

        def out(kind, x, y, n=None):
            n = np.ones(len(x)) if n is None else n
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(n.astype(np.int32))], names)

        def region(bucket, low):
            return (low.astype(np.int64) * buckets + bucket).astype(np.int64)

        for bucket, parts in _by_bucket(batches):
            shingles, sets = [], []
            for kind, raw, ids in parts:
                ids = np.frombuffer(ids, np.int64)
                if kind:
                    full = np.frombuffer(raw, np.uint64)
                    home = (full % np.uint64(buckets)).astype(np.int64)
                    yield out(1, ids, region(home, _low(full, buckets)))
                else:
                    shingles.append(np.frombuffer(raw, np.uint32))
                    sets.append(ids)
            if not shingles:
                continue
            shingles, sets = np.concatenate(shingles), np.concatenate(sets)
            order = np.lexsort((sets, shingles))
            shingles, sets = shingles[order], sets[order]
            fresh = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (sets[1:] != sets[:-1])])
            shingles, sets = shingles[fresh], sets[fresh]
            start = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
            size = np.diff(np.append(start, len(shingles)))
            marked = sets[start] == -1
            large = marked | (size > SMALL_REGION)
            own = np.repeat(large, size) & (sets >= 0)
            if own.any():
                yield out(1, sets[own], region(bucket, shingles[own]))
            pairs = []
            for k in np.unique(size[~large]):
                if k > 1:
                    block = sets[start[~large & (size == k)][:, None] + np.arange(k)]
                    i, j = np.triu_indices(k, 1)
                    pairs.append(np.stack([block[:, i].ravel(), block[:, j].ravel()], axis=1))
            if pairs:
                both, n = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
                yield out(0, both[:, 0], both[:, 1], n)

    dealt = entries.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(join, "kind int, x long, y long, n int")


def _by_bucket(batches):
    current, parts = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for kind, bucket, raw, ids in zip(*columns):
            if bucket != current and parts:
                yield current, parts
                parts = []
            current = bucket
            parts.append((kind, raw, ids))
    if parts:
        yield current, parts


def _texts_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, text) with the text of one document for each wanted set."""
    one = (sets.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_key")).alias("d"))
           .join(wanted, "set_id").select("set_id", "d.doc_id", "d.text_key"))
    one = kept(one, "wanted-sets")
    texts = docs.select("doc_id", "text_key", "text").join(one, ["doc_id", "text_key"]).select("set_id", "text")
    return kept(texts.dropDuplicates(["set_id"]), "wanted-texts")


def _common(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Adds common, x_size and y_size to distinct pairs (x, y) of set ids."""
    joined = (pairs.join(texts.withColumnsRenamed({"set_id": "x", "text": "x_text"}), "x")
              .join(texts.withColumnsRenamed({"set_id": "y", "text": "y_text"}), "y").select("x", "y", "x_text", "y_text"))

    def count(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, COMPARED_AT_ONCE):
                known, rows = {}, []
                for x, y, a, b in zip(*(each(c) for c in batch.slice(at, COMPARED_AT_ONCE).columns)):
                    for key, text in ((x, a), (y, b)):
                        if key not in known:
                            known[key] = shingle_set(text, width)
                    one, two = known[x], known[y]
                    rows.append((x, y, len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["x", "y", "common", "x_size", "y_size"])

    return joined.mapInArrow(count, "x long, y long, common long, x_size long, y_size long")


def _links(compared: DataFrame, rule: Threshold) -> DataFrame:
    return compared.where(100 * F.col("common") >= rule.share * (F.col("x_size") + F.col("y_size") - F.col("common"))).select("x", "y")


def _ordered(x, y):
    return F.least(x, y).alias("x"), F.greatest(x, y).alias("y")


def _distinct_cells(cells: DataFrame) -> DataFrame:
    """One cell of those that have the same members, by two hashes of them; cells of one member are left out."""
    alike = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "x")).alias("two"))
             .where("n > 1").groupBy("n", "one", "two").agg(F.min("cell").alias("cell")))
    return cells.join(alike, "cell", "left_semi")


def _sketch(prints) -> bytes:
    """Parities of the numbers of shingles that fall on each bit, some 4 bits a shingle.

    Two sets' sketches differ in no more bits than the sets in shingles; one folded in half is the sketch of half the bits.
    """
    import numpy as np
    bits = min(MOST_BITS, max(512, 1 << (4 * len(prints) - 1).bit_length()))
    return np.packbits((np.bincount((prints & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """(x, size, sketch) of sets (set_id, text)."""
    def rows(batches):
        import pyarrow as pa
        for batch in batches:
            found = []
            for x, text in zip(*(each(c) for c in batch.columns)):
                prints = shingle_set(text, width)
                found.append((x, len(prints), _sketch(prints)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["x", "size", "sketch"])

    return texts.select("set_id", "text").mapInArrow(rows, "x long, size long, sketch binary")


def _differences(one: list, two: list):
    """Bits that two lists of sketches of any lengths differ in, the longer one folded: a matrix."""
    import numpy as np
    out = np.zeros((len(one), len(two)), np.int64)
    lengths = [np.array([len(s) for s in side]) for side in (one, two)]
    for a in np.unique(lengths[0]):
        for b in np.unique(lengths[1]):
            at = [np.flatnonzero(own == n) for own, n in zip(lengths, (a, b))]
            words = []
            for side, own in zip((one, two), at):
                block = np.frombuffer(b"".join(side[i] for i in own), np.uint64).reshape(len(own), -1)
                while block.shape[1] * 8 > min(a, b):
                    half = block.shape[1] // 2
                    block = block[:, :half] ^ block[:, half:]
                words.append(block)
            step = max(1, (8 << 20) // (len(at[1]) * int(min(a, b))))
            for start in range(0, len(at[0]), step):
                part = words[0][start:start + step]
                out[np.ix_(at[0][start:start + step], at[1])] = np.bitwise_count(part[:, None, :] ^ words[1][None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def _across(named: DataFrame, sketches: DataFrame, rule: Threshold, closest: bool) -> DataFrame:
    """Pairs x < y of sets that share a cell (cell, x, c), not a component c, and may be similar by their sizes and sketches.

    With ``closest`` one pair a set, that whose sketches differ least. A cell's largest component is never compared with
    itself, so a cell of near copies costs its members times the others; both are dealt into blocks of about BLOCK, and a
    task holds two blocks.
    """
    parts = named.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("n"))
    tops = (parts.groupBy("cell").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all")).where("all > m.n")
            .select("cell", F.col("m.c").alias("top"), F.ceil(F.col("m.n") / BLOCK).alias("ib"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).alias("ob")))
    rows = named.join(tops, "cell").join(sketches, "x").withColumn("inner", F.col("c") == F.col("top"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("x"), F.when(F.col("inner"), F.col("ib")).otherwise(F.col("ob"))))
    rows = rows.withColumn("place", F.when(F.col("inner"), F.col("ob") + F.col("block")).otherwise(F.col("block")))
    ahead = F.transform(F.sequence(F.lit(0).cast("long"), F.when(F.col("inner"), F.col("ob") - 1).otherwise(F.col("place"))), lambda i: F.struct(i.alias("i"), F.col("place").alias("j")))
    behind = F.transform(F.sequence(F.col("place"), F.col("ob") + F.col("ib") - 1), lambda j: F.struct(F.col("place").alias("i"), j.alias("j")))
    both = F.when(F.col("inner"), ahead).otherwise(F.array_distinct(F.concat(ahead, behind)))
    dealt = rows.withColumn("g", F.explode(both)).select("cell", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "place", "inner", "x", "c", "size", "sketch")

    def compared(members):
        import numpy as np
        import pyarrow as pa
        x, c, size, place, inner = (members[k].to_numpy() for k in ("x", "c", "size", "place", "inner"))
        i, j = members["i"][0].as_py(), members["j"][0].as_py()
        sketch = members["sketch"].to_pylist()
        left, right = np.flatnonzero(place == i), np.flatnonzero(place == j)
        out = [np.empty(0, np.int64)] * 3
        if len(left) and len(right):
            total, apart = size[left][:, None] + size[right][None, :], np.minimum(size[left][:, None], size[right][None, :])
            open_ = (c[left][:, None] != c[right][None, :]) & (100 * apart >= rule.share * (total - apart))
            if open_.any():
                differ = _differences([sketch[k] for k in left], [sketch[k] for k in right])
                common = (total - differ) // 2
                open_ &= 100 * common >= rule.share * (total - common)
                score = np.where(open_, 1_000_000 * differ // total, 1 << 40)
                if closest:
                    best, back, own = score.argmin(axis=1), score.argmin(axis=0), np.flatnonzero(~inner[right])
                    p, q = np.concatenate([np.arange(len(left)), back[own]]), np.concatenate([best, own])
                    out = [np.concatenate([x[left], x[right[own]]]), np.concatenate([x[right[best]], x[left[back[own]]]]), score[p, q]]
                    met = out[2] < 1 << 40
                    out = [v[met] for v in out]
                else:
                    p, q = np.nonzero(open_)
                    out = [x[left[p]], x[right[q]], score[p, q]]
        return pa.table([pa.array(v, pa.int64()) for v in out], ["x", "y", "score"])

    found = dealt.groupBy("cell", "i", "j").applyInArrow(compared, "x long, y long, score long")
    if closest:
        found = found.groupBy("x").agg(F.min(F.struct("score", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
    return found.select(*_ordered(F.col("x"), F.col("y"))).distinct()


def _star(named: DataFrame, turn: int) -> DataFrame:
    """Pairs x < y: a set with the member that most of its cells have as their least by a hash of the round, if that is of another component.

    So a round takes a row per membership and one pair a set.
    """
    pivots = (named.groupBy("cell").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "x").alias("h"), F.col("x").alias("p"), F.col("c").alias("pc"))).alias("m"),
                                        F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("cell", "m.p", "m.pc"))
    met = named.join(pivots, "cell").where("c <> pc").groupBy("x", "p").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("x").agg(F.max(F.struct("n", "p")).alias("m")).select(*_ordered(F.col("x"), F.col("m.p"))).distinct()


def _large_regions(cells: DataFrame, sketches: DataFrame, lookup, rule: Threshold) -> DataFrame:
    """Links that connect whatever links connect within large regions (cell, x).

    Cells of the same members are one. First near copies are connected: round by round a set is compared with one member
    of another component, chosen by ``_star`` and then by its sketch, as long as a quarter of those pairs are links. Then
    all pairs of different components that share a cell and that sizes and sketches leave open are compared on their
    texts. Sketches bound the number of common shingles from above, so no link is lost.
    """
    cells = kept(_distinct_cells(cells), "cells")
    spark = cells.sparkSession
    compared = kept(spark.createDataFrame([], "x long, y long, common long, x_size long, y_size long"), "compared")
    stage, named = "star", cells.withColumn("c", F.col("x"))
    for turn in itertools.count():
        named = kept(named, "named")
        pairs = _star(named, turn) if stage == "star" else _across(named, sketches, rule, stage == "closest")
        asked = kept(pairs.join(compared.select("x", "y"), ["x", "y"], "left_anti"), "asked")
        found = kept(lookup(asked), "found")
        compared = kept(compared.union(found), "compared")
        if stage == "all":
            return _links(compared, rule)
        if 4 * _links(found, rule).count() <= asked.count():
            stage = "closest" if stage == "star" else "all"
        known = components(_links(compared, rule), "connected").withColumnRenamed("node", "x")
        named = cells.join(known, "x", "left").select("cell", "x", F.coalesce("component", "x").alias("c"))


def _rarest_first(texts: DataFrame, rule: Threshold, width: int) -> DataFrame:
    """(cell, x): each set (set_id, text) in the regions of its rarest shingles, as many as it takes to meet all partners.

    All sets order their shingles alike, by the number of ``texts`` that have them, so a region of many sets only holds
    those that consist of frequent shingles for the most part. One row per shingle and set is counted, and shingles of
    more than one set are joined back; a set's others come first in its order. Only the shingles of one set are ever gathered.
    """
    def rows(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            found = [(x, shingle_set(t, width).view(np.int64)) for x, t in zip(*(each(c) for c in batch.columns))]
            size = [len(p) for _, p in found]
            least = [n - rule.common(n) + 1 for n in size]
            prints = np.concatenate([p for _, p in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x for x, _ in found], np.int64), size)), pa.array(prints),
                                              pa.array(np.repeat(np.array(size, np.int32), size)), pa.array(np.repeat(np.array(least, np.int32), size))],
                                             ["x", "cell", "size", "least"])

    all_rows = texts.select("set_id", "text").mapInArrow(rows, "x long, cell long, size int, least int")
    often = kept(all_rows.groupBy("cell").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "shingle-counts")
    ordered = all_rows.join(often, "cell").groupBy("x", "size", "least").agg(F.array_sort(F.collect_list(F.struct("often", "cell"))).alias("cells"))
    left = F.greatest(F.col("least") - (F.col("size") - F.size("cells")), F.lit(0))
    return ordered.select("x", F.explode(F.slice("cells", F.lit(1), left)).alias("c")).select(F.col("c.cell").alias("cell"), "x")


def similar_groups(docs: DataFrame, share: int = 75, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) per row of ``docs``; text_key is xxhash64 of the text.

    Two documents link if their sets of ``width``-word shingles are similar by ``share`` / 100 or more; component_id is
    the smallest doc_id that links lead to. Equal sets are one node, so copies are never compared. A set's prefix is its
    least shingles, so many that partners share several of them; pairs that share too few in regions of up to
    SMALL_REGION sets are left out by count, and each other pair is compared on its whole texts unless links found
    before connect it. Sets whose prefix has more shingles
    of large regions than partners share anyhow take the regions of their rarest shingles instead; those that are large
    all the same, of sets with many near copies, are joined by stars and sketches. Null, empty and wordless texts have no shingles, link with nothing and are their own component; rows with
    a null id link with nothing; rows of one id may be in two components. An empty table gives no rows.
    """
    rule = Threshold(share)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sets = kept(document_sets(docs, width), "sets")
    spark = docs.sparkSession
    entries = (sets.agg(F.sum("size")).first()[0] or 0) * (100 - share + 11) // 100
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET_ENTRIES))
    regions = kept(_regions(_prefix_entries(docs.where("doc_id is not null"), buckets, rule, width), buckets), "regions")
    nodes = sets.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.first("size").alias("size"))
    memberships = regions.where("kind = 1").select("x", "y").distinct()
    large = memberships.groupBy(F.col("x").alias("set_id")).agg(F.count(F.lit(1)).alias("large"))
    least_slack = F.floor(F.ceil(F.col("size") * share / 100) / 10)
    sized = nodes.join(large, "set_id", "left").select(
        "set_id", "size", F.coalesce("large", F.lit(0)).alias("large"), F.floor(F.col("size") / 10).alias("slack"),
        (F.coalesce("large", F.lit(0)) > least_slack).alias("crowded"))
    pairs = regions.where("kind = 0").groupBy("x", "y").agg(F.sum("n").alias("n"))
    one, two = (sized.select(F.col("set_id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("size", "large", "slack"))) for k in ("x", "y"))
    need = F.least("x_slack", "y_slack") + 1 - F.least("x_large", "y_large")
    pairs = (pairs.join(one, "x").join(two, "y")
             .where((F.col("n") >= need) & (100 * F.least("x_size", "y_size") >= share * F.greatest("x_size", "y_size"))).select("x", "y", "n"))
    pairs = kept(pairs, "pairs")
    crowd = kept(sized.where("crowded").select("set_id"), "crowded")
    wanted = pairs.select("x").union(pairs.select("y")).union(crowd).distinct().withColumnRenamed("x", "set_id")
    texts = _texts_of(docs, sets, wanted)
    crowded = kept(texts.join(crowd, "set_id", "left_semi"), "crowded-texts")
    cells, sketches = _rarest_first(crowded, rule, width), kept(_sketches(crowded, width), "sketches")

    def lookup(asked: DataFrame, texts: DataFrame = texts) -> DataFrame:
        return _common(asked, texts, width)

    both = pairs.union(pairs.select("y", "x", "n"))
    best = both.groupBy("x").agg(F.max(F.struct("n", "y")).alias("b")).select(*_ordered(F.col("x"), F.col("b.y"))).distinct()
    links = kept(_links(lookup(best), rule).union(_large_regions(cells, sketches, lambda asked: lookup(asked, crowded), rule)), "links")
    known = kept(components(links, "sets-first"), "known")
    left, right = (known.select(F.col("node").alias(k), F.col("component").alias(f"{k}_c")) for k in ("x", "y"))
    open_pairs = (pairs.select("x", "y").join(best, ["x", "y"], "left_anti").join(left, "x", "left").join(right, "y", "left")
                  .where(F.coalesce("x_c", "x") != F.coalesce("y_c", "y")).select("x", "y"))
    more = _links(lookup(open_pairs), rule)
    groups = components(links.union(more), "sets-all").select(F.col("node").alias("set_id"), "component")
    classes = kept(sets.where("doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"))
                   .where("set_id is not null").join(groups, "set_id", "left")
                   .select("set_id", "low", F.coalesce("component", "set_id").alias("component")), "classes")
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "component").select("set_id", "component_id")
    joined = sets.join(classes, "set_id", "left")
    return joined.select("doc_id", "text_key", F.col("size").alias("n_shingles"),
                         F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, share: int = 75, width: int = SHINGLE) -> DataFrame:
    """``docs`` without those whose component has a smaller doc_id. Repeated rows are one document; they stay or go together."""
    docs, restore = set_aside(docs, ["doc_id", "text"], [])
    groups = similar_groups(docs, share, width)
    others = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    return restore(docs.join(others, (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_k")), "left_anti"))
