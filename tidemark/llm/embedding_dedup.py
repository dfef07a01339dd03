"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.exact_topk import usable
from tidemark.llm.storage import kept

#: rows of one bucket that are compared at once; larger buckets are cut in blocks of about this many
BLOCK_ROWS = 1024
PAIR_SCHEMA = "vec_id long, other long, links long"


def table_shape(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits a table and number of tables, for some four unrelated rows a bucket.

    Two vectors at the threshold agree in one sign with probability 1 - angle / pi; the tables are as many as it takes
    for such a pair to meet in one of them with probability ``recall``.
    """
    bits = min(max(math.ceil(math.log2(max(rows, 2) / 4)), 4), 30)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _signs(vectors, tables: int, bits: int, seed: int):
    import numpy as np
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)
    return ((vectors @ planes > 0).reshape(len(vectors), tables, bits) @ weights).astype(np.int64)


def _compare(ids, counts, vectors, signs, block, pair, table: int, threshold: float):
    """Rows (vec_id, smallest linked id of its local component, links) of one bucket, or of one pair of its blocks.

    A pair that already met in an earlier table is not counted again.
    """
    import numpy as np
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    linked = vectors @ vectors.T / np.outer(norms, norms) >= threshold
    np.fill_diagonal(linked, False)
    if pair[0] != pair[1]:
        linked &= block[:, None] != block[None, :]
    first, second = np.nonzero(linked)
    if not len(first):
        return None
    fresh = np.ones(len(first), bool)
    for t in range(table):
        fresh &= signs[first, t] != signs[second, t]
    links = np.bincount(first[fresh], counts[second[fresh]].astype(float), len(ids)).astype(np.int64)
    label = ids.copy()
    while True:
        lower = label.copy()
        np.minimum.at(lower, first, label[second])
        if (lower == label).all():
            break
        label = lower
    some = (links > 0) | (label != ids)
    return ids[some], label[some], links[some]


def links_and_components(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.98, seed: int = 7,
                         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are one class with a count, so copies meet in no bucket. Classes are put in one bucket per table by
    the signs of their products with random planes. A bucket of more than ``block_rows`` classes is cut in blocks, and
    each pair of its blocks is a step of its own, so no step is larger, whatever a bucket holds. Cosines are exact, in
    double precision. Steps give each class its number of links, and links to the smallest member of each local
    component, never the pairs. Vectors that are null, zero or hold null or non-finite components, and rows with a null
    id, have no links and are their own component. Vectors of different lengths are never linked. Rows of one id share
    their links and component. No row of the table, no bucket and no component goes through the driver.
    """
    kind = dict(vectors.dtypes)["embedding"]
    width = "<f4" if kind == "array<float>" else "<f8"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if width == "<f4" else "array<double>").alias("v"))
    valid = usable(F.col("v")) & F.col("vec_id").isNotNull() & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    members = rows.withColumn("v", F.when(valid, F.col("v")))
    classes = kept(members.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    bits, tables = table_shape(classes.count(), threshold, recall)

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            v = batch.column("v")
            lengths = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(width)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                own = flat[(starts[at][:, None] + np.arange(length)).ravel()].reshape(len(at), length)
                signs = _signs(own.astype(np.float64), tables, bits, seed)
                ids, n = batch.column("rep").to_numpy()[at], batch.column("n").to_numpy()[at]
                raw = pa.array([x.tobytes() for x in own], pa.binary())
                sign_bytes = pa.array([x.tobytes() for x in signs], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(signs[:, t]), pa.array(np.full(len(at), length, np.int32)),
                         pa.array(ids), pa.array(n), raw, sign_bytes], ["t", "bucket", "d", "rep", "n", "raw", "signs"])

    placed = classes.mapInArrow(hashed, "t int, bucket long, d int, rep long, n long, raw binary, signs binary")
    large = (placed.groupBy("t", "bucket", "d").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_rows)
             .select("t", "bucket", "d", F.ceil(F.col("size") / block_rows).cast("int").alias("blocks")))
    cut = placed.join(kept(large, "buckets"), ["t", "bucket", "d"], "left")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    cut = (cut.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
           .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .withColumns({"p": F.least("own", "o"), "q": F.greatest("own", "o")}))
    keys = ["t", "bucket", "d", "p", "q"]
    dealt = cut.select(*keys, "own", "rep", "n", "raw", "signs").repartition(*keys).sortWithinPartitions(*keys)

    def compared(batches):
        import numpy as np
        import pyarrow as pa

        def step(part):
            if part.num_rows < 2:
                return None
            t, _, d, p, q = (part.column(i)[0].as_py() for i in range(5))
            vectors_ = np.frombuffer(b"".join(part.column("raw").to_pylist()), width).reshape(-1, d).astype(np.float64)
            signs = np.frombuffer(b"".join(part.column("signs").to_pylist()), np.int64).reshape(-1, tables)
            return _compare(part.column("rep").to_numpy(), part.column("n").to_numpy(), vectors_, signs,
                            part.column("own").to_numpy(), (p, q), t, threshold)

        carried = None
        for part, last in _groups(batches, len(keys)):
            carried = part if carried is None else pa.concat_tables([carried, part])
            if last:
                found = step(carried)
                carried = None
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["vec_id", "other", "links"])

    found = kept(dealt.mapInArrow(compared, PAIR_SCHEMA), "vector-links")
    groups = components(found.select("vec_id", "other"), "vector-components")
    counts = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    nodes = (classes.select("v", "rep", "n").join(counts, "rep", "left")
             .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
             .select(F.col("v").alias("_v"), F.coalesce("component", "rep").alias("_component"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links")))
    joined = members.join(nodes, F.col("v") == F.col("_v"), "left")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("_component", "vec_id").alias("component_id"),
                         F.coalesce(F.col("vec_id") == F.coalesce("_component", "vec_id"), F.lit(True)).alias("kept"))


def _groups(batches, keys: int):
    """(rows, whether its key ends there) of consecutive rows with equal first ``keys`` columns, over all batches."""
    import numpy as np
    import pyarrow as pa
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)], axis=1)
        if held is not None:
            yield held[0], not (held[1] == values[0]).all()
        ends = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        at = 0
        table = pa.Table.from_batches([batch])
        for end in ends.tolist():
            yield table.slice(at, end - at), True
            at = end
        held = table.slice(at), values[-1]
    if held is not None:
        yield held[0], True
