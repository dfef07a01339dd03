"""Toxicity by class-conditional Kneser-Ney models of words and the words before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.storage import dropped, each, kept, set_aside

#: letters of a word's beginning, the order that words back off to
BEGINNING = 4
DISCOUNT = 0.75
#: characters of the texts that are scored together, and keys that chunks send to one range, about
CHUNK, ENTRIES_A_RANGE = 12 << 20, 400_000
#: bits of a key beyond those that number the words of all texts: whatever the input, two entries share a key with a chance of 2 ** -24
SPARE_BITS = 24
#: parts that texts meet labels and are examined in, and that pairs are counted in, one after the other, so that only a part is shuffled at a time
PARTS, PAIR_PARTS = 4, 2
#: labelled rows the score's calibration is fitted on at most
MOST_CALIBRATION = 20_000
WINDOWS = (1, 5)
#: values of a word: after the word before it, alone, and alone as far as SURE distinct words come before it (else its beginning's)
ORDERS, SURE = 3, 3
FEATURES = 1 + ORDERS * (1 + len(WINDOWS))
#: calibration where one class has fewer than FEW_ROWS rows: the best word must be some 400 times likelier in toxic texts
FEW_ROWS, DEFAULT_WEIGHTS = 5, (-6.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: folds that are learned from; each is scored for the calibration by models that leave it out
FOLDS = (0, 1, 3)
#: counts of an entry in ordinary and toxic texts: of all learning rows, and without each fold
COUNTS = ["n0", "n1", *(f"f{fold}_{c}" for fold in FOLDS for c in (0, 1))]
#: kinds of entries: pairs of words, words, beginnings
PAIR, WORD, BEGIN = range(3)
#: columns of a word's or beginning's entry, a block of COUNTS each. Of a word: before how many distinct words it is met, how often and
#: before how many distinct words another follows it. Of a beginning: how many distinct words have it, and the sum of their first block
BLOCKS = 3
ENTRY = [f"{block}{c}" for block in "tak" for c in COUNTS]


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters of the whole text."""
    return _LETTERS(text.lower()) if text else []


def _letters():
    import re
    return re.compile(r"[^\W\d_]+").findall


_LETTERS = _letters()


def _key(word: str) -> int:
    """64 bits: above, those of the word's beginning, which is what ``key >> 32`` gives; below, those of the word."""
    import xxhash
    key = xxhash.xxh3_64_intdigest(word[:BEGINNING]) >> 32 << 32 | xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF
    return key - (1 << 64) if key >> 63 else key


def with_folds(docs: DataFrame) -> DataFrame:
    """Adds _fold: crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return docs.withColumn("_fold", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)))


def _pack(array) -> bytes:
    """The first bytes of all numbers of an array, then the second ones and so on, compressed after the size of all."""
    import numpy as np
    import pyarrow as pa
    array = np.ascontiguousarray(array).reshape(-1)
    raw = array.view(np.uint8).reshape(array.size, array.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind):
    import numpy as np
    import pyarrow as pa
    size, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(packed[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, size // width).T).view(kind).reshape(-1)


def _pack_keys(keys) -> bytes:
    """Ascending keys, as the steps between them."""
    import numpy as np
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes):
    import numpy as np
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


def chunks(docs: DataFrame, labels: DataFrame) -> list[DataFrame]:
    """The texts as numbers of words, about CHUNK characters a row: words' keys, word numbers, and length, kind and digest by text.

    A text's kind is -1 if nothing is learned from it (no label, or fold 2), else toxic + 2 * (the fold's place in FOLDS); learning texts
    have chunks of their own. Repeated labels of an id count as the highest. Texts without words are left out. One table a part of
    the documents, by their ids.
    """
    marks = kept(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "toxic-marks")
    kind = F.when(F.col("toxic").isNull() | (F.col("_fold") == 2), -1).otherwise((F.col("toxic") > 0).cast("int") + 2 * F.least("_fold", F.lit(2)).cast("int"))
    rows = with_folds(docs.select("doc_id", "text"))

    def encoded(batches):
        from pyspark import TaskContext
        task, made = TaskContext.get().partitionId(), 0
        gathered = {False: _Texts(), True: _Texts()}
        for batch in batches:
            for text, kind, d in zip(*(each(c) for c in batch.columns)):
                own = gathered[kind >= 0]
                own.add(text, kind, d)
                if own.size >= CHUNK:
                    yield own.row((task * PARTS + part) << 32 | made, kind >= 0)
                    made += 1
                    gathered[kind >= 0] = _Texts()
        for learns, own in gathered.items():
            if own.runs:
                yield own.row((task * PARTS + part) << 32 | made, learns)
                made += 1

    parts = []
    for part in range(PARTS):
        own = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == part).join(marks, "doc_id", "left").select("text", kind.alias("kind"), digest().alias("d"))
        parts.append(kept(own.mapInArrow(encoded, "chunk long, learns boolean, places long, names long, begins binary, begin binary, rest binary, "
                                                  "seq binary, lengths binary, kinds binary, digests binary"), "toxic-chunks"))
    dropped(marks)
    return parts


class _Texts:
    """Texts that become one row of ``chunks``."""

    def __init__(self):
        from collections import defaultdict
        from itertools import count
        self.number, self.runs, self.kinds, self.digests, self.size = defaultdict(count().__next__), [], [], [], 0

    def add(self, text, kind: int, d: bytes) -> None:
        import numpy as np
        own = words(text)
        if own:
            self.runs.append(np.fromiter(map(self.number.__getitem__, own), np.uint32, len(own)))
            self.kinds.append(kind)
            self.digests.append(d)
            self.size += len(text)

    def row(self, chunk: int, learns: bool):
        import numpy as np
        import pyarrow as pa
        heads, lengths = np.array([_key(w) for w in self.number], np.int64), np.array([len(r) for r in self.runs], np.int64)
        begins, begin = np.unique((heads >> 32).astype(np.int32), return_inverse=True)
        packed = {"begins": _pack(begins), "begin": _pack(begin.astype(np.uint32)), "rest": heads.astype(np.uint32).tobytes(), "seq": _pack(np.concatenate(self.runs)), "lengths": _pack(lengths),
                  "kinds": _pack(np.array(self.kinds, np.int8)), "digests": b"".join(self.digests)}
        return pa.RecordBatch.from_pydict(
            {"chunk": [chunk], "learns": [learns], "places": [int(lengths.sum())], "names": [len(heads)], **{k: [v] for k, v in packed.items()}},
            pa.schema([("chunk", pa.int64()), ("learns", pa.bool_()), ("places", pa.int64()), ("names", pa.int64()), *((k, pa.binary()) for k in packed)]))


def digest():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _rows(batch):
    """The rows of an Arrow batch one by one."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Chunk:
    """One row of ``chunks``, whose places hold pairs (previous word, word). Names are its words' keys, then 0 for the start of a text."""

    def __init__(self, row: dict):
        import numpy as np
        begins, begin, rest = _unpack(row["begins"], np.int32), _unpack(row["begin"], np.uint32), np.frombuffer(row["rest"], np.uint32)
        self.names = np.append(begins[begin].astype(np.int64) << 32 | rest, 0)
        self.lengths, self.kinds = _unpack(row["lengths"], np.int64), _unpack(row["kinds"], np.int8)
        self.digests = [row["digests"][i:i + 16] for i in range(0, len(row["digests"]), 16)]
        self.current = _unpack(row["seq"], np.uint32)
        self.previous = np.concatenate([self.current[:1], self.current[:-1]])
        self.previous[np.cumsum(self.lengths) - self.lengths] = len(self.names) - 1

    def _place_keys(self, width: int):
        """The key of the pair at each place; what depends on the previous word alone is mixed once a name."""
        return _joined(width, self.names[self.current], _seeded(PAIR, self.names)[self.previous])

    def pairs(self, width: int):
        """Ascending distinct keys of its pairs, the slot among them of each place, and numbers of the previous word and the word by key."""
        import numpy as np
        keys, slots = np.unique(self._place_keys(width), return_inverse=True)
        one = np.empty(len(keys), np.int64)
        one[slots[::-1]] = np.arange(len(slots) - 1, -1, -1)
        return keys, slots, self.previous[one], self.current[one]

    def part_pairs(self, width: int, bits: int, part: int):
        """Ascending distinct keys of its pairs in the ranges of one of PAIR_PARTS parts; of learning texts also how often each occurs, by kind of text.

        Places are chosen before anything is sorted, so all parts together sort each place once."""
        import numpy as np
        keys = self._place_keys(width)
        own = (keys >> np.uint64(width - bits)) % np.uint64(PAIR_PARTS) == part
        if (self.kinds < 0).any():
            return np.unique(keys[own]), None
        keys, slots = np.unique(keys[own], return_inverse=True)
        kinds = np.repeat(self.kinds, self.lengths)[own]
        return keys, np.stack([np.bincount(slots[kinds == kind], minlength=len(keys)) for kind in range(2 * len(FOLDS))])

    def entries(self, width: int):
        """Ascending distinct keys of its names and their beginnings, and the slots among them of both, by name."""
        import numpy as np
        keys, slots = np.unique(np.concatenate([_mixed(WORD, width, self.names), _mixed(BEGIN, width, self.names >> 32)]), return_inverse=True)
        return keys, *np.split(slots, 2)


def _by_range(keys, width: int, bits: int):
    """(range, slice) of ascending keys of ``width`` bits; the range is their first ``bits``."""
    import numpy as np
    ranges, starts = np.unique(keys >> np.uint64(width - bits), return_index=True)
    return [(int(b), slice(start, end)) for b, start, end in zip(ranges, starts.tolist(), [*starts[1:].tolist(), len(keys)])]


REQUEST = "b int, chunk long, learns boolean, keys binary, counts binary"
ANSWER = "b int, chunk long, learns boolean, marks binary, counts binary"


def _requests(b: list, chunk: int, learns: bool, keys: list, counts: list):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([chunk] * len(b), pa.int64()), pa.array([learns] * len(b), pa.bool_()),
                                       pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["b", "chunk", "learns", "keys", "counts"])


def _answers(requests, marks: list, counts: list):
    """What goes back to the chunks: of each key asked for, in order, a mark, and the counts of the marked ones."""
    import pyarrow as pa
    return pa.table({**{c: requests[c] for c in ("b", "chunk", "learns")}, "marks": pa.array([_pack(m) for m in marks], pa.binary()),
                     "counts": pa.array([_pack(c) for c in counts], pa.binary())})


def _answered(answers, columns: int):
    """(marks, counts) of a chunk's keys in ascending order, from the answers of all their ranges; counts of unmarked keys are 0."""
    import numpy as np
    rows = sorted(zip(answers["b"].to_pylist(), answers["marks"], answers["counts"]), key=lambda r: r[0])
    marks = np.concatenate([np.empty(0, np.uint8), *(_unpack(m.as_py(), np.uint8) for _, m, _ in rows)])
    counts = np.zeros((len(marks), columns), np.int64)
    counts[marks > 0] = np.concatenate([np.empty((0, columns), np.int64), *(_unpack(c.as_py(), np.int64).reshape(columns, -1).T for _, _, c in rows)])
    return marks, counts


def _with_folds_left_out(tallies):
    """COUNTS from the counts by kind of text, the first two of them where only all learning rows are counted."""
    import numpy as np
    if tallies.shape[1] == 2:
        return tallies
    by = tallies.reshape(len(tallies), len(FOLDS), 2)
    total = by.sum(axis=1)
    return np.concatenate([total, *(total - by[:, f] for f in range(len(FOLDS)))], axis=1)


def pair_answers(texts: DataFrame, width: int, bits: int, part: int) -> DataFrame:
    """To each chunk, how often its pairs occur in learning texts; a mark of 2 says that the chunk is the first that has the pair.

    Learning chunks get counts by kind of text, others by class. Only the ranges of one of PAIR_PARTS parts are asked. Pairs are dealt by ranges of their keys, not by words, and a chunk sends each of its pairs once, so no frequent pair or word is
    gathered in one task. A chunk sends at most one row a range, and no more rows than it has pairs.
    """
    def asked(batches):
        for batch in batches:
            for row in _rows(batch):
                chunk = Chunk(row)
                keys, tallies = chunk.part_pairs(width, bits, part)
                dealt = _by_range(keys, width, bits)
                yield _requests([b for b, _ in dealt], row["chunk"], row["learns"], [_pack_keys(keys[own]) for _, own in dealt],
                                [_pack(tallies[:, own]) if row["learns"] else None for _, own in dealt])

    def tallied(requests):
        import numpy as np
        requests = requests.sort_by([("learns", "descending"), ("chunk", "ascending")])
        asked_for = [_unpack_keys(k.as_py()) for k in requests["keys"]]
        keys, first, slots = np.unique(np.concatenate(asked_for), return_index=True, return_inverse=True)
        is_first = np.zeros(len(slots), bool)
        is_first[first] = True
        ends = np.cumsum([len(k) for k in asked_for])[:-1]
        total = np.zeros((2 * len(FOLDS), len(keys)), np.int64)
        for own, counts in zip(np.split(slots, ends), requests["counts"].to_pylist()):
            if counts is not None:
                total[:, own] += _unpack(counts, np.int64).reshape(len(total), -1)
        met = total.any(axis=0)
        marks = np.split(met[slots] * (1 + is_first).astype(np.uint8), ends)
        by_class = total.reshape(len(FOLDS), 2, -1).sum(axis=0)
        return _answers(requests, marks, [(total if learns else by_class)[:, own[met[own]]]
                                          for own, learns in zip(np.split(slots, ends), requests["learns"].to_pylist())])

    return texts.mapInArrow(asked, REQUEST).groupBy("b").applyInArrow(tallied, ANSWER)


def word_counts(texts: DataFrame, answers: DataFrame, width: int) -> DataFrame:
    """(w, ENTRY): the entries of words; 0 is the start of a text. Each distinct pair is counted by the first chunk that has it."""
    def gained(rows, answers):
        import numpy as np
        import pyarrow as pa
        out = [(np.empty(0, np.int64), np.empty((0, len(ENTRY)), np.int64))]
        for row in rows.to_pylist():
            chunk = Chunk(row)
            _, _, previous, current = chunk.pairs(width)
            marks, counts = _answered(answers, 2 * len(FOLDS))
            own = marks == 2
            previous, current, counts = previous[own], current[own], _with_folds_left_out(counts[own])
            blocks = [(current, counts > 0), (previous, counts), (previous, counts > 0)]
            entry = np.stack([np.bincount(at, weights=c, minlength=len(chunk.names)) for at, block in blocks for c in block.T], axis=1).astype(np.int64)
            met = entry.any(axis=1)
            out.append((chunk.names[met], entry[met]))
        names, entry = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(names), *(pa.array(np.ascontiguousarray(c)) for c in entry.T)], ["w", *ENTRY])

    rows = texts.where("learns").groupBy("chunk").cogroup(answers.where("learns").groupBy("chunk")).applyInArrow(gained, "w long, " + ", ".join(f"{c} long" for c in ENTRY))
    return rows.groupBy("w").agg(*(F.sum(c).alias(c) for c in ENTRY))


def _mix(x):
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(kind: int, v):
    """What the kind of entry and the word before add to a key."""
    import numpy as np
    with np.errstate(over="ignore"):
        return _mix(np.atleast_1d(np.asarray(v, np.int64)).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(kind + 1))


def _joined(width: int, w, seed):
    import numpy as np
    with np.errstate(over="ignore"):
        return _mix(seed ^ np.atleast_1d(np.asarray(w, np.int64)).view(np.uint64)) >> np.uint64(64 - width)


def _mixed(kind: int, width: int, w):
    """Keys of ``width`` bits of entries: splitmix64 of the kind of entry and a word or beginning."""
    return _joined(width, w, _seeded(kind, 0))


class Model:
    """Totals of one pair of models; the counts themselves are looked up."""

    def __init__(self, at: int, sums: dict, tops: dict):
        self.at = slice(at, at + 2)
        names = COUNTS[self.at]
        self.m, self.k = ([sums[f"{s}{c}"] for c in names] for s in "sk")
        self.b, self.bk = ([tops[f"{s}{c}"] for c in names] for s in "sk")
        self.all = tops["all" + names[0]]
        self.known = all(self.m)

    def values(self, word, beginning, inside, pair, after, kinds_after):
        """Log ratios toxic / ordinary, of words given the word before and of words alone. Arguments are this model's counts, one row each.

        Orders are discounted per class; what is taken off goes to the next order: a word after another, by how often
        they occur so, backs off to the word (after how many distinct words of the class it comes), that to its beginning
        (by how many distinct words of the class begin so) times a share of the word in its beginning that both classes have in
        common, beginnings to their share over both classes. What both have in common cancels for words never met.
        """
        import numpy as np
        if not self.known:
            return [np.zeros(len(word))] * ORDERS
        m, b, inside, n = word, beginning, inside.sum(axis=1), pair
        met = m.sum(axis=1)
        share = np.where(met > 0, met / np.maximum(inside, 1), 1.0)
        top = (b.sum(axis=1) + 0.5) / (sum(self.b) + 0.5 * self.all)
        p, alone, begins = [], [], []
        for c in (0, 1):
            begin = np.maximum(b[:, c] - DISCOUNT, 0) / self.b[c] + DISCOUNT * self.bk[c] / self.b[c] * top
            begins.append(DISCOUNT * self.k[c] / self.m[c] * begin)
            alone.append(np.maximum(m[:, c] - DISCOUNT, 0) / self.m[c] + DISCOUNT * self.k[c] / self.m[c] * begin * share)
            left = np.where(after[:, c] > 0, DISCOUNT * kinds_after[:, c] / np.maximum(after[:, c], 1), 1.0)
            p.append(np.maximum(n[:, c] - DISCOUNT, 0) / np.maximum(after[:, c], 1) + left * alone[c])
        single = np.log(alone[1] / alone[0])
        return [np.log(p[1] / p[0]), single, np.where(met >= SURE, single, np.log(begins[1] / begins[0]))]


def _block(name: str) -> list[str]:
    return [c for c in ENTRY if c[0] == name]


def learned(words_: DataFrame):
    """(beginnings, models): (w, ENTRY) of beginnings, and the totals of the models of all rows and without each fold."""
    met, summed = ([agg(c).alias(to + c[1:]) for c in _block("t")] for to, agg in (("t", lambda c: F.sum((F.col(c) > 0).cast("long"))), ("a", F.sum)))
    beginnings = kept(words_.groupBy(F.shiftright("w", 32).alias("w")).agg(*met, *summed, *(F.lit(0).cast("long").alias(c) for c in _block("k"))), "toxic-beginnings")
    totals = [agg for c in COUNTS for agg in (F.sum(f"t{c}").alias(f"s{c}"), F.sum((F.col(f"t{c}") > 0).cast("long")).alias(f"k{c}"))]
    either = [F.sum((F.col(f"t{a}") + F.col(f"t{b}") > 0).cast("long")).alias("all" + a) for a, b in zip(COUNTS[::2], COUNTS[1::2])]
    sums, tops = (df.agg(*totals, *either).first().asDict() for df in (words_, beginnings))
    return beginnings, [Model(at, sums, tops) for at in range(0, len(COUNTS), 2)]


def entry_answers(texts: DataFrame, words_: DataFrame, beginnings: DataFrame, width: int, bits: int) -> DataFrame:
    """To each chunk, the entries of its words and their beginnings; of chunks that learn nothing, their columns of all learning rows."""
    def keyed(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            kind, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            key = np.where(kind == WORD, _mixed(WORD, width, w), _mixed(BEGIN, width, w))
            b = (key >> np.uint64(width - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(key.view(np.int64)), *batch.columns[2:]], ["b", "key", *ENTRY])

    def asked(batches):
        for batch in batches:
            for row in _rows(batch):
                keys, *_ = Chunk(row).entries(width)
                dealt = _by_range(keys, width, bits)
                yield _requests([b for b, _ in dealt], row["chunk"], row["learns"], [_pack_keys(keys[own]) for _, own in dealt], [None] * len(dealt))

    def found(entries, requests):
        import numpy as np
        keys = entries["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys = np.append(keys[order], ~np.uint64(0))
        columns = [np.append(entries[c].to_numpy()[order], 0) for c in ENTRY]
        marks, counts = [], []
        for wanted, learns in zip(requests["keys"], requests["learns"].to_pylist()):
            wanted = _unpack_keys(wanted.as_py())
            at = np.searchsorted(keys, wanted)
            hit = (keys[at] == wanted) & (at < len(keys) - 1)
            marks.append(hit.astype(np.uint8))
            counts.append(np.stack([c[at[hit]] for i, c in enumerate(columns) if learns or i % len(COUNTS) < 2]))
        return _answers(requests, marks, counts)

    rows = words_.select(F.lit(WORD).alias("kind"), "w", *ENTRY).unionByName(beginnings.select(F.lit(BEGIN).alias("kind"), "w", *ENTRY))
    rows = rows.mapInArrow(keyed, "b int, key long, " + ", ".join(f"{c} long" for c in ENTRY))
    return rows.groupBy("b").cogroup(texts.mapInArrow(asked, REQUEST).groupBy("b")).applyInArrow(found, ANSWER)


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(d, kind, x, t): features of each text with words under the models of all learning rows, and of labelled ones under those without their fold.

    Every entry is kept at any size. Chunks of texts send the distinct keys of their pairs to ranges of keys, which count
    them and send back what the learning texts have; the same then goes on with words and beginnings, whose counts come
    from the pairs. Keys are as long as their number needs and SPARE_BITS more. Nothing is broadcast but totals.
    """
    text_parts = chunks(docs, labels)
    texts = reduce(DataFrame.unionByName, text_parts)
    size = texts.agg(F.sum("places").alias("places"), F.sum("names").alias("names")).first()
    places, names = size["places"] or 0, 2 * (size["names"] or 0)
    width = min(64, places.bit_length() + SPARE_BITS)
    bits, entry_bits = (max(4, (n // ENTRIES_A_RANGE).bit_length()) for n in (places, names))
    pair_parts = [kept(pair_answers(texts, width, bits, part), "toxic-pairs") for part in range(PAIR_PARTS)]
    of_pairs = reduce(DataFrame.unionByName, pair_parts)
    words_ = kept(word_counts(texts, of_pairs, width), "toxic-words")
    beginnings, models = learned(words_)
    of_entries = kept(entry_answers(texts, words_, beginnings, width, entry_bits), "toxic-entries")
    dropped(words_, beginnings)

    def examined(rows, answers):
        import pyarrow as pa
        import pyarrow.compute as pc
        out = {"d": [], "kind": [], "x": [], "t": []}
        for row in rows.to_pylist():
            chunk = Chunk(row)
            _, slots, previous, current = chunk.pairs(width)
            _, by_word, by_beginning = chunk.entries(width)
            kinds, counts = (2 * len(FOLDS), len(COUNTS)) if row["learns"] else (2, 2)
            _, tallies = _answered(answers.filter(answers["of_pairs"]), kinds)
            _, entries = _answered(answers.filter(pc.invert(answers["of_pairs"])), BLOCKS * counts)
            tallies = _with_folds_left_out(tallies)
            words_, begins = entries[by_word].reshape(-1, BLOCKS, counts), entries[by_beginning].reshape(-1, BLOCKS, counts)

            def summary(model):
                values = model.values(words_[current, 0, model.at], begins[current, 0, model.at], begins[current, 1, model.at],
                                      tallies[:, model.at], words_[previous, 1, model.at], words_[previous, 2, model.at])
                return _summary([v[slots] for v in values], chunk.lengths)

            without = [summary(m) for m in models[1:]] if row["learns"] else []
            out["d"] += chunk.digests
            out["kind"] += chunk.kinds.tolist()
            out["x"] += summary(models[0])
            out["t"] += [without[kind // 2][i] if kind >= 0 else [] for i, kind in enumerate(chunk.kinds.tolist())]
        return pa.table(out, pa.schema([("d", pa.binary()), ("kind", pa.int32()), ("x", pa.list_(pa.float64())), ("t", pa.list_(pa.float64()))]))

    answers = of_pairs.withColumn("of_pairs", F.lit(True)).unionByName(of_entries.withColumn("of_pairs", F.lit(False)))
    parts = []
    for part in range(PARTS):
        own, theirs = (df.where(F.pmod(F.xxhash64("chunk"), F.lit(PARTS)) == part).groupBy("chunk") for df in (texts, answers))
        parts.append(kept(own.cogroup(theirs).applyInArrow(examined, "d binary, kind int, x array<double>, t array<double>"), "toxic-features"))
    dropped(*text_parts, *pair_parts, of_entries)
    return reduce(DataFrame.unionByName, parts)


def _summary(orders, lengths) -> list[list[float]]:
    """By text: mean, the highest mean over 1 and over 5 words in a row, by order; and the log of the word count."""
    import numpy as np
    ends = np.cumsum(lengths)
    starts, left = ends - lengths, np.repeat(ends, lengths) - np.arange(ends[-1])
    out = []
    for values in orders:
        means = np.add.reduceat(values, starts) / lengths
        out.append(means)
        for w in WINDOWS:
            sums = values.copy()
            for i in range(1, w):
                sums[:-i] += values[i:]
            sums[left < w] = -np.inf
            out.append(np.where(lengths < w, means, np.maximum.reduceat(sums, starts) / w))
    return np.stack([*out, np.log1p(lengths)], axis=1).tolist()


def _fit_logistic(features, marks, ridge: float = 1e-2, steps: int = 50):
    """Newton steps on standardised features, given back as weights of the raw ones, the constant first."""
    import numpy as np
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.hstack([np.ones((len(features), 1)), (features - mean) / spread])
    weights = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty / len(x) + 1e-9 * np.eye(x.shape[1]),
                               x.T @ (p - marks) / len(x) + penalty @ weights / len(x))
        weights = weights - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    raw = weights[1:] / spread
    return np.concatenate([[weights[0] - raw @ mean], raw])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` with _held_out, _score (0 to 1) and _predicted (1 from ``threshold`` on).

    The models and the calibration learn from labelled rows outside fold 2 only, and from their text and label alone.
    Counts cover all of those rows. Each learning row is also scored by models without its fold; on at most
    MOST_CALIBRATION of these a logistic regression turns the log-likelihood differences into a score; the models that
    score ``docs`` use all learning rows. Scores meet their rows again by a digest of the text. Null, empty and wordless texts have no
    evidence and get the score of zero differences. Without labels of both classes every difference is 0. Where a class has
    fewer than FEW_ROWS learning rows nothing can be fitted, and DEFAULT_WEIGHTS take the calibration's place. Repeated rows
    get equal scores, very long texts are scored whole, and an empty table gives no rows.
    """
    import numpy as np
    docs, restore = set_aside(docs, ["doc_id", "text"], ["_held_out", "_score", "_predicted"])
    examined = features(docs, labels)
    sample = examined.where("kind >= 0").select("t", "kind").orderBy(F.xxhash64("t")).limit(MOST_CALIBRATION).collect()
    marks = np.array([r["kind"] % 2 == 1 for r in sample], float)
    if min(marks.sum(), len(marks) - marks.sum()) < FEW_ROWS:
        weights = np.array(DEFAULT_WEIGHTS)
    else:
        weights = _fit_logistic(np.array([r["t"] for r in sample]), marks)
    constant, *slopes = (float(w) for w in weights)

    def chance(x):
        total = F.lit(constant)
        for i, slope in enumerate(slopes):
            total = total + F.lit(slope) * x[i]
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))

    scores = kept(examined.groupBy("d").agg(F.first("x").alias("x")).select("d", chance(F.col("x")).alias("_score")), "toxic-scores")
    nothing = chance([F.lit(0.0)] * FEATURES)
    found = docs.withColumn("d", digest()).join(scores, "d", "left").withColumn("_score", F.coalesce("_score", nothing)).drop("d")
    return restore(with_folds(found).withColumns({"_held_out": F.col("_fold") == 2, "_predicted": (F.col("_score") >= threshold).cast("int")}))
