"""WARC archives through a chunk table: record id, chunk number, bytes and the digest up to there."""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.storage import kept

CHUNK_BYTES = 64 << 10
#: payload bytes of a file before compression, about
FILE_BYTES = 64 << 20
#: fixed values: record terminator and version of the format; the date is a parameter of the archive
END, VERSION, DATE = "\r\n\r\n", "WARC/1.1", "2024-01-01T00:00:00Z"
CHUNKS = "record_id string, page_id long, url string, chunk int, last boolean, bytes long, digest string, data binary"


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (record_id, page_id, url, chunk, last, bytes, digest, data) of each page's payload, the html in UTF-8.

    A payload is cut by byte position in the JVM and its chunks pass one after the other, so the SHA-1 (upper-case
    base32) and byte count of a record are carried from chunk to chunk and no later step holds a whole payload. digest
    and bytes are those up to and with the chunk; the row marked last has the record's. Null and empty payloads have one
    empty chunk. record_id is unique, also for repeated rows and null ids. Other columns are not used.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("data_") / chunk_bytes).cast("int") - 1, F.lit(0)))
    cut = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("data_"))
           .withColumn("record_id", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
                                                F.monotonically_increasing_id().cast("string")))
           .withColumn("chunk", F.explode(numbers))
           .select("record_id", "page_id", "url", "chunk", (F.length("data_") <= (F.col("chunk") + 1) * F.lit(chunk_bytes)).alias("last"),
                   F.substring(F.col("data_"), F.col("chunk") * F.lit(chunk_bytes) + 1, F.lit(chunk_bytes)).alias("data")))
    return cut.mapInArrow(_digested, CHUNKS)


def _digested(batches) -> Iterator:
    """Adds bytes and digest up to each chunk; chunks of a record follow each other."""
    import hashlib

    import pyarrow as pa
    state, total = None, 0
    for batch in batches:
        sizes, digests = [], []
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
            if chunk == 0:
                state, total = hashlib.sha1(), 0
            raw = data.as_buffer()
            state.update(raw)
            total += raw.size
            sizes.append(total)
            digests.append(base64.b32encode(state.digest()).decode())
        columns = [batch.column(n) for n in ("record_id", "page_id", "url", "chunk", "last")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column("data")],
                                         ["record_id", "page_id", "url", "chunk", "last", "bytes", "digest", "data"])


def record_types(chunks: DataFrame, at_least: int = 0) -> DataFrame:
    """(record_id, total, payload_digest, refers_to) per record, from the last chunks alone.

    Of records with equal payloads of at least ``at_least`` bytes, those of the smallest page_id are responses and the
    others revisit it (refers_to is that id); a null page_id is above all others. Smaller payloads are all responses.
    """
    records = chunks.where("last").select("record_id", "page_id", F.col("bytes").alias("total"), F.col("digest").alias("payload_digest"))
    first = kept(records.where(F.col("total") >= at_least).groupBy("payload_digest").agg(F.min("page_id").alias("first")), "warc-first")
    refers = F.when((F.col("total") >= at_least) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return records.join(first, "payload_digest", "left").select("record_id", "total", "payload_digest", refers.alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line breaks in the value, which a header can't hold, are percent-encoded."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), _coded(value.cast("string"), "\r", "\n"), F.lit("\r\n")), F.lit(""))


def _coded(value: Column, *signs: str) -> Column:
    for sign in signs:
        value = F.replace(value, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return value


def write_archives(chunks: DataFrame, types: DataFrame, path: str, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Writes WARC files: a response per record, in segments of one chunk if it has several, or a revisit without payload.

    The first segment is the response, later ones are continuations that name it and their number; the last has the
    total length. Every row is a complete WARC record of at most a chunk, written as it passes. Records are dealt by
    record_id and their chunks sorted, so the segments of a record follow each other in one file. Page id, payload
    length and the page a revisit refers to are in extension headers, and so is the original of a url with line breaks.
    Files are as many as ``file_bytes`` of payload and headers make, and are compressed as a whole.
    """
    size = chunks.agg(F.coalesce(F.sum(F.when(F.col("last"), F.col("bytes") + 512)), F.lit(0))).first()[0]
    files = max(1, -(-size // file_bytes))
    rows = chunks.repartition(files, "record_id").join(types.repartition(files, "record_id"), "record_id").where("refers_to is null or chunk = 0")
    revisit, several = F.col("refers_to").isNotNull(), ~(F.col("last") & (F.col("chunk") == 0))
    data = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("data"))
    kind = F.when(revisit, "revisit").when(F.col("chunk") == 0, "response").otherwise("continuation")
    first_id = F.concat(F.lit("<urn:record:"), F.col("record_id"), F.lit(":0>"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _header("WARC-Type", kind),
        F.concat(F.lit("WARC-Record-ID: <urn:record:"), F.col("record_id"), F.lit(":"), F.col("chunk").cast("string"), F.lit(">\r\n")),
        F.lit(f"WARC-Date: {date}\r\n"), _header("WARC-Target-URI", F.col("url")),
        _header("X-Target-URI-Coded", F.when(F.col("url").rlike("[\r\n]"), _coded(F.col("url"), "%", "\r", "\n"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Segment-Number", F.when(several & ~revisit, F.col("chunk") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(F.col("chunk") > 0, first_id)),
        _header("WARC-Segment-Total-Length", F.when(several & ~revisit & F.col("last"), F.col("total"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        _header("X-Page-ID", F.col("page_id")), _header("X-Payload-Length", F.col("total")), _header("X-Refers-To-Page", F.col("refers_to")),
        _header("Content-Length", F.length(data)), F.lit("\r\n"))
    record = F.concat(head.cast("binary"), data).cast("string")
    (rows.sortWithinPartitions("record_id", "chunk").select(record.alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record read: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A gzip file is one stream, read in lines, which are at most a chunk and some headers long. The parser follows
    Content-Length and carries the digest over the segments of a response. For a response bytes and digest are those of
    what was read; for a revisit those its record states. Broken records raise an error.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(_parsed, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _parsed(batches) -> Iterator:
    import hashlib
    import urllib.parse

    import pyarrow as pa
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    waiting, out = bytearray(), []
    state, total, first = None, 0, None

    def number(text):
        return None if text is None else int(text)

    def finish(head, size, digest):
        if number(head.get("X-Payload-Length")) != size or head["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        coded = head.get("X-Target-URI-Coded")
        kind = "revisit" if head["WARC-Type"] == "revisit" else "response"
        out.append((number(head.get("X-Page-ID")), head.get("WARC-Target-URI") if coded is None else urllib.parse.unquote(coded),
                    size, digest, kind, number(head.get("X-Refers-To-Page"))))

    for batch in batches:
        waiting += b"\n".join([x.as_buffer() for x in batch.column(0)]) + b"\n" if batch.num_rows else b""
        at = 0
        while (ends := waiting.find(b"\r\n\r\n", at)) >= 0:
            lines = waiting[at:ends].decode().split("\r\n")
            if lines[0] != VERSION:
                raise ValueError(f"not a record: {lines[0][:80]!r}")
            head = dict(line.split(": ", 1) for line in lines[1:])
            start, size = ends + 4, int(head["Content-Length"])
            if len(waiting) < start + size + 4:
                break
            body = bytes(waiting[start:start + size])
            at = start + size + 4
            if head["WARC-Type"] == "revisit":
                finish(head, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"))
                continue
            if head["WARC-Type"] == "response":
                state, total, first = hashlib.sha1(), 0, head["WARC-Record-ID"]
            elif head.get("WARC-Segment-Origin-ID") != first:
                raise ValueError(f"segment without its record: {head['WARC-Record-ID']}")
            state.update(body)
            total += size
            if "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head:
                finish(head, total, base64.b32encode(state.digest()).decode())
        del waiting[:at]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    if waiting:
        raise ValueError("an archive ends within a record")


def archive(pages: DataFrame, path: str, at_least: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html) to ``path`` and gives the rows read back from them.

    The chunk table is written once to the scratch folder: digests, types and archives come from one copy. An empty
    table gives no rows.
    """
    chunks = kept(chunk_table(pages, chunk_bytes), "warc-chunks")
    write_archives(chunks, record_types(chunks, at_least), path)
    return read_archives(pages.sparkSession, path)
