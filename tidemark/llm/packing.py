"""Best-fit-decreasing packing of token sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.storage import each, kept, schema_of, with_columns

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: pieces meant for each slice, in which pieces of one length are numbered, and slices at most
SLICE_ROWS, MOST_SLICES = 1000, 4096


class OpenBins:
    """How many bins are open for each remaining capacity: a segment tree of sums over capacities 0..capacity.

    ``tightest(n)`` gives the smallest remaining capacity of at least ``n`` with an open bin, in logarithmic time.
    Bins of one capacity are runs of consecutive bin numbers that got the same lengths.
    """

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _add(self, free: int, count: int) -> None:
        node = free + self.leaves
        while node:
            self.tree[node] += count
            node //= 2

    def put(self, free: int, first: int, count: int) -> None:
        if count:
            self.runs.setdefault(free, []).append((first, count))
            self._add(free, count)

    def take(self, free: int, most: int) -> tuple[int, int]:
        """Up to ``most`` consecutive bins with ``free`` left, which are then closed."""
        first, count = self.runs[free].pop()
        if count > most:
            self.runs[free].append((first + most, count - most))
            count = most
        self._add(free, -count)
        return first, count

    def tightest(self, need: int) -> int | None:
        node = need + self.leaves
        if self.tree[node]:
            return need
        while node > 1 and (node % 2 or not self.tree[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Best-fit-decreasing over a histogram of lengths (each from 1 to ``capacity``).

    Per length: runs (first rank, pieces, first bin, pieces a bin, offset) for the pieces of that length, ranked in any
    order. Equal pieces are placed together: a bin of the tightest capacity takes as many as fit, since what is left of
    it stays the tightest place for the next. The result is that of one piece at a time.
    """
    bins, made, out = OpenBins(capacity), 0, {}
    for length in sorted(counts, reverse=True):
        rank, left, runs = 0, counts[length], []
        while left:
            free = bins.tightest(length)
            each = (capacity if free is None else free) // length
            if free is None:
                free, first, count = capacity, made, -(-left // each)
                made += count
            else:
                first, count = bins.take(free, -(-left // each))
            whole = min(count, left // each)
            if whole:
                runs.append((rank, whole * each, first, each, capacity - free))
                bins.put(free - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if count > whole:
                runs.append((rank, left, first + whole, each, capacity - free))
                bins.put(free - left * length, first + whole, 1)
                rank, left = rank + left, 0
        out[length] = runs
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Per document its ids and ``end_id``, cut in pieces of ``capacity`` ids if longer; the first may be shorter.

    Columns doc_id, piece, start, length, ids_crc32. A null text is empty and gives the end id alone; a null id stays
    null; repeated rows are pieces of their own; other columns are not used.
    """
    def cut(batches) -> Iterator:
        import pyarrow as pa
        from tidemark.llm.tokens import encoder
        end = end_id.to_bytes(4, "little")
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, ids in zip(each(batch.column(0)), encode.batch(each(batch.column(1)))):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                at, upto, piece = 0, n % capacity or min(n, capacity), 0
                while at < n:
                    rows.append((doc, piece, at, upto - at, zlib.crc32(ids[4 * at:4 * upto])))
                    at, upto, piece = upto, upto + capacity, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int, label: str = "packing") -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (columns doc_id, piece, length and any more).

    Lengths from 1 to ``capacity`` are counted, and that histogram, whose size does not depend on the data, is packed.
    A piece's place follows from its rank among those of its length: the rank in its slice plus the sizes of the slices
    before. A length that many pieces share is thus ranked in many tasks.
    Ranks among equal lengths are arbitrary but written down once. An empty table gives no rows.
    """
    from itertools import chain
    pieces = kept(pieces, label)
    total = pieces.agg(F.count(F.lit(1))).first()[0]
    slices = min(max(1, -(-total // SLICE_ROWS)), MOST_SLICES)
    cut = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    sizes = cut.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rules = plan(counts, capacity)
    rows = list(chain.from_iterable(((length, *run) for run in runs) for length, runs in rules.items()))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(
        Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece")
    ranked = (cut.withColumn("_rank", F.row_number().over(rank) - 1)
              .join(ahead.drop("_n"), ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_ahead")))
    return _placed(ranked, rows, pieces.columns)


def _placed(ranked: DataFrame, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Looks each rank up in the runs of its length; lengths without pieces have none."""
    import numpy as np
    order = sorted(rows)
    runs = ranked.sparkSession.sparkContext.broadcast(np.array(order, np.int64).reshape(-1, 6))
    of_length: dict[int, tuple[int, int]] = {}
    for i, row in enumerate(order):
        of_length[row[0]] = (of_length.get(row[0], (i, i))[0], i + 1)

    def place(batches):
        table = runs.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
            at = np.empty(len(length), np.int64)
            for one in np.unique(length):
                first, last = of_length[int(one)]
                mine = length == one
                at[mine] = first - 1 + np.searchsorted(table[first:last, 1], rank[mine], side="right")
            run = table[at]
            within = rank - run[:, 1]
            yield with_columns(batch.select(columns), {"sequence_id": run[:, 3] + within // run[:, 4],
                                                       "offset": run[:, 5] + within % run[:, 4] * length})

    return ranked.mapInArrow(place, schema_of(ranked.select(*columns), "sequence_id long", "offset long"))
