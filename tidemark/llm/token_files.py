"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.storage import kept

#: ids are unsigned 32-bit; vocabularies stay below 2^31, so ORC's 32-bit integer holds them; file and place are the order
IDS = "doc_id long, ids array<int>, file int, place long"
#: documents a file is meant for; each is written by one task
FILE_ROWS = 8192


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, stride: int = 1000) -> None:
    """Writes (doc_id, ids, file, place) of all ``docs`` in ascending doc_id order, null ids first, equal ids by a hash of the text.

    Texts, not ids, are dealt by id range and sorted; each task then encodes its range in order and writes one file. Each row
    has the number of its range and its place there, so the order doesn't rest on names of files. ORC encodes the integers by runs and deltas, keeps a row index entry each ``stride``
    rows, and a Bloom filter of the ids in it, so a reader of some ids skips stripes and row groups; stripes can be read
    in parallel. Null and empty texts give the end id alone. Other columns are not used. An empty table gives one empty
    file or none.
    """
    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from tidemark.llm.tokens import encoder
        coder = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        number, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            texts = batch.column(1).to_pylist()
            for size in _portions(texts):
                encoded = [ids + end for ids in coder.batch(texts[at:at + size])]
                ends = np.cumsum([0, *(len(x) // 4 for x in encoded)], dtype=np.int32)
                ids = pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), pa.ListArray.from_arrays(pa.array(ends), ids),
                                                  pa.array(np.full(size, number, np.int32)), pa.array(np.arange(place, place + size))],
                                                 ["doc_id", "ids", "file", "place"])
                at += size
                place += size

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = max(1, -(-docs.count() // FILE_ROWS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # rows without an id are dealt out as well
    (docs.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(encode, IDS)
     .write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", str(stride))
     .option("orc.create.index", "true").orc(path))


def _portions(texts: list, most: int = 8 << 20) -> list[int]:
    """Row counts of consecutive portions of about ``most`` characters."""
    out, rows, size = [], 0, 0
    for text in texts:
        rows, size = rows + 1, size + len(text or "")
        if size >= most:
            out.append(rows)
            rows, size = 0, 0
    return out + [rows] if rows else out


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The (doc_id, ids, file, place) rows of the files; a filter on doc_id skips stripes and row groups."""
    return spark.read.schema(IDS).orc(path)


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document of read files.

    Documents are summed within their file by their places, files by their numbers, so nothing but one row per file is ever
    in one place. The files are read once.
    """
    def digest(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(ends).astype(np.int64)),
                                              pa.array(crc, pa.int64())], ["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    rows = kept(files.select("doc_id", "ids", "file", "place").mapInArrow(digest, "doc_id long, file int, place long, n_tokens long, ids_crc32 long"), "token-digests")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("_all"))
    ahead = sums.select("file", F.coalesce(F.sum("_all").over(Window.orderBy("file").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ahead, "file")
            .select("doc_id", (F.col("_ahead") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32"))
