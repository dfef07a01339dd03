"""Substring deduplication: windows of words that an earlier document has are removed, after a count-min prefilter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shingling import Fingerprints, mixed, split_words, word_hashes
from tidemark.llm.storage import dropped, each, kept, schema_of, set_aside

WINDOW = 50
#: words of an anchor: a window's anchor is the run of so many of its words with the smallest fingerprint
ANCHOR = 16
#: counters of a sketch row for each anchor counted, and rows
CELLS_PER_ANCHOR, SKETCH_ROWS = 8, 2
RUNS = "anchor long, print long, doc_id long, text_key long, first int, count int"


def anchored_runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Rows (anchor, print, doc_id, text_key, first, count): ``count`` windows in a row from ``first`` with one anchor.

    Equal windows have equal anchors, at the same place within, so all copies of a window are in runs with its anchor.
    ``print`` is the fingerprint of all the words the run's windows cover.
    """
    def runs(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = []
            for doc, key, text in zip(*(each(c) for c in batch.columns)):
                words = split_words(text)
                if len(words) < window:
                    continue
                prints = Fingerprints(word_hashes(words))
                anchors = prints.windows(anchor)
                views = np.lib.stride_tricks.sliding_window_view(anchors, window - anchor + 1)
                place = np.arange(len(views)) + views.argmin(axis=1)
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                count = np.diff(np.append(first, len(place)))
                covered = prints.of(first, first + count + window - 1) + mixed(count.astype(np.uint64))
                out.append((anchors[place[first]].view(np.int64), covered.view(np.int64), np.full(len(first), doc),
                            np.full(len(first), key), first.astype(np.int32), count.astype(np.int32)))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in ("i8",) * 4 + ("i4",) * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "print", "doc_id", "text_key", "first", "count"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text_key", "text").mapInArrow(runs, RUNS)


def estimated_repeated(runs: DataFrame) -> DataFrame:
    """The runs whose anchor a count-min sketch estimates to be there twice or more; none that is gets lost.

    Each partition adds its anchors up in its own cells, the cells of all partitions are merged by sum, and the estimate
    is the least over the rows of the sketch. The cells are a distributed table whose width follows the number of
    anchors, so the share of false estimates is the same at every size. A window is there at most as often as its anchor.
    """
    width = CELLS_PER_ANCHOR * max(1, runs.count())
    cell = [F.pmod(F.xxhash64(F.lit(row), "anchor"), F.lit(width)) for row in range(SKETCH_ROWS)]
    cells = runs.select(F.explode(F.array(*[F.struct(F.lit(row).alias("row"), c.alias("cell")) for row, c in enumerate(cell)])).alias("x"))
    sketch = kept(cells.groupBy("x.row", "x.cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row", "cell"), "sketch")
    for row in range(SKETCH_ROWS):
        heavy = sketch.where(F.col("row") == row).select(F.col("cell").alias("_heavy"))
        runs = runs.join(heavy, cell[row] == F.col("_heavy"), "left_semi")
    return runs


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, end): words that windows cover whose word sequence starts in a smaller doc_id too.

    ``docs`` has doc_id, text_key and text. Runs estimated repeated are grouped exactly: of runs with equal words only
    the smallest document's can be first ones, all windows of the others are repeats. Where an anchor has runs that
    differ, the windows of those first ones are grouped by two 64-bit fingerprints of their words. Groups are minima,
    made before the shuffle, and are written and joined back (a join of written tables is cut up where a key is hot), so copies of a passage in any share of the documents never meet in
    one task.
    """
    runs = kept(anchored_runs(docs, window), "runs")
    candidates = kept(estimated_repeated(runs), "repeated-runs")
    dropped(runs)
    groups = kept(candidates.groupBy("anchor", "print").agg(F.min("doc_id").alias("m")), "run-groups")
    grouped = candidates.join(groups, ["anchor", "print"])
    copies = grouped.where("doc_id > m").select("doc_id", "text_key", F.col("first").alias("start"), (F.col("first") + F.col("count") + window - 1).alias("end"))
    several = kept(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    firsts = grouped.where("doc_id = m").join(several, "anchor", "left_semi")
    per_document = kept(firsts.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "count")).alias("runs")), "first-runs")

    def prints(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = []
            for doc, key, text, first_runs in zip(*(each(c) for c in batch.columns)):
                hashes = word_hashes(split_words(text))
                at = np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in first_runs])
                one, two = (Fingerprints(hashes, k).of(at, at + window) for k in (0, 1))
                out.append((one.view(np.int64), two.view(np.int64), np.full(len(at), doc), np.full(len(at), key), at.astype(np.int32)))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in ("i8",) * 4 + ("i4",)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "doc_id", "text_key", "start"])

    windows = kept(docs.select("doc_id", "text_key", "text").join(per_document, ["doc_id", "text_key"])
                   .mapInArrow(prints, "one long, two long, doc_id long, text_key long, start int"), "windows")
    earliest = kept(windows.groupBy("one", "two").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").drop("x"), "first-windows")
    single = (windows.join(earliest, ["one", "two"]).where("doc_id > m")
              .select("doc_id", "text_key", "start", (F.col("start") + window).alias("end")))
    return copies.union(single)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with _n_words, _n_removed and _kept (the words left, joined by one space).

    A word goes if a window of ``window`` words that covers it has its word sequence in a document of a smaller doc_id
    too; windows are judged on the texts as they are, not on what is left. A null text has no words and keeps an empty
    text. Rows of equal doc_id do not repeat each other; rows with a null doc_id lose nothing and repeat nothing. Texts
    of fewer than ``window`` words stay, but for their white space.
    """
    docs, restore = set_aside(docs, ["doc_id", "text"], ["_n_words", "_n_removed", "_kept"])
    columns = docs.columns
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    spans = repeated_spans(keyed.select("doc_id", F.col("_text_key").alias("text_key"), "text"), window)
    spans = spans.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    joined = keyed.join(spans, (F.col("doc_id") == F.col("_d")) & (F.col("_text_key") == F.col("_k")), "left").select(*columns, "_spans")

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            counts, removed, texts = [], [], []
            spans_ = batch.column(len(columns))
            for text, own in zip(each(batch.column(columns.index("text"))), each(spans_)):
                words = split_words(text)
                counts.append(len(words))
                if own:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["start"] for s in own], 1)
                    np.add.at(change, [s["end"] for s in own], -1)
                    words = [w for w, covered in zip(words, np.cumsum(change[:-1]).tolist()) if not covered]
                removed.append(counts[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                                             [*columns, "_n_words", "_n_removed", "_kept"])

    return restore(joined.mapInArrow(cut, schema_of(docs, "_n_words long", "_n_removed long", "_kept string")))
