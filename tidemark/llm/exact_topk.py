"""Exact top-k by inner product with a vector-approximation file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.storage import dropped, kept

CELL_BITS = 6
#: rows whose components share their cells, rows of one step, and queries of one step
BLOCK_ROWS, STEP_ROWS, QUERY_ROWS = 2048, 65_536, 4096
#: queries whose bounds are held at once, and exact vectors a query reads first, as a multiple of k
PORTION, FIRST = 256, 2


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def _cells(exact, bits: int):
    """Cell numbers of each component between the block's least and greatest value, with the cells' lower ends and width."""
    import numpy as np
    low = exact.min(axis=0)
    width = np.maximum((exact.max(axis=0) - low + 1) / float(1 << bits), 1e-9)
    return np.minimum((exact - low) / width, (1 << bits) - 1).astype(np.uint8), low, width


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (r, vec_id, d, v) without copies of a vector that can be among no query's best.

    Scores of copies are equal and go by vec_id, and a query leaves out one id: the k + 1 smallest ids of a vector, k
    rows of each, are enough for any. Vectors with more rows are found by two 64-bit hashes; map tasks cut their rows.
    """
    same = ["h", "i"]
    marked = rows.select("r", "vec_id", F.xxhash64("d", "v").alias("h"), F.xxhash64("v", F.lit(1)).alias("i"))
    crowded = marked.groupBy(*same).count().where(F.col("count") > k + 1).select(*same)
    inside = kept(marked.join(crowded, same), "topk-copies")
    repeats, ids = Window.partitionBy(*same, "vec_id").orderBy("r"), Window.partitionBy(*same).orderBy("vec_id")
    few = (inside.withColumn("n", F.row_number().over(repeats)).where(F.col("n") <= k)
           .withColumn("m", F.dense_rank().over(ids)).where(F.col("m") <= k + 1))
    return rows.join(inside.join(few, "r", "left_anti").select("r"), "r", "left_anti")


def approximation_file(exact: DataFrame, bits: int = CELL_BITS, block_rows: int = BLOCK_ROWS, step_rows: int = STEP_ROWS) -> DataFrame:
    """(b, d, rows, ids, cells, low, width): a row per block of ``exact`` (r, vec_id, d, v), a byte per component; b is its step."""
    def quantised(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            r, ids, sizes = (batch.column(i).to_numpy() for i in range(3))
            flat, ends = batch.column(3).flatten().to_numpy(), np.cumsum(sizes)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                for at in range(0, len(own), block_rows):
                    rows = own[at:at + block_rows]
                    cells, low, width = _cells(flat[(ends[rows] - d)[:, None] + np.arange(d)], bits)
                    packed = (r[rows], ids[rows], cells, low.astype(np.float64), width)
                    yield pa.RecordBatch.from_pydict(
                        {"b": [part << 32 | made // max(1, step_rows // block_rows)], "d": [d], **{n: [x.tobytes()] for n, x in zip(names, packed)}},
                        pa.schema([("b", pa.int64()), ("d", pa.int32()), *((n, pa.binary()) for n in names)]))
                    made += 1

    names = ("rows", "ids", "cells", "low", "width")
    return exact.select("r", "vec_id", "d", "v").mapInArrow(quantised, "b long, d int, " + ", ".join(f"{n} binary" for n in names))


def _scan(k: int):
    """A step: the rows of its blocks that may be among the k best of a query, with bounds of their scores."""
    def scan(blocks, queries):
        import numpy as np
        import pyarrow as pa
        out = [[np.empty(0, t)] for t in (np.int64, np.int64, np.float64, np.float64)]
        if blocks.num_rows and queries.num_rows:
            d = queries["d"][0].as_py()
            numbers, own_ids = queries["q"].to_numpy(), queries["vec_id"].to_numpy()
            vectors = queries["v"].combine_chunks().flatten().to_numpy().reshape(queries.num_rows, d).astype(np.float64)
            blocks = blocks.to_pylist()
            for at in range(0, len(vectors), PORTION):
                query, own = vectors[at:at + PORTION], own_ids[at:at + PORTION]
                best = np.full((len(query), k), -np.inf)
                met = []
                for block in blocks:
                    rows, ids = (np.frombuffer(block[n], np.int64) for n in ("rows", "ids"))
                    low, width = (np.frombuffer(block[n]) for n in ("low", "width"))
                    cells = np.frombuffer(block["cells"], np.uint8).reshape(len(rows), d)
                    near = (query @ low)[:, None] + (query * width) @ (cells + 0.5).T
                    # half a cell in every component, and what doubles may lose in these sums
                    most = np.maximum(np.abs(low), np.abs(low + width * 256))
                    slack = (np.abs(query) @ width / 2 * (1 + 1e-9) + np.abs(query) @ most * (d + 8) * 2.0 ** -50)[:, None]
                    near[own[:, None] == ids[None, :]] = -np.inf
                    least = near - slack
                    if len(rows) > k:
                        least = np.partition(least, len(rows) - k, axis=1)[:, len(rows) - k:]
                    best = np.hstack([best, least])
                    best = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k:]
                    i, j = np.nonzero((near + slack >= best.min(axis=1)[:, None]) & (near > -np.inf))
                    met.append((i, rows[j], near[i, j] - slack[i, 0], near[i, j] + slack[i, 0]))
                i, row, lower, upper = (np.concatenate(x) for x in zip(*met))
                stay = upper >= best.min(axis=1)[i]
                for column, x in zip(out, (numbers[at:at + PORTION][i[stay]], row[stay], lower[stay], upper[stay])):
                    column.append(x)
        return pa.table([pa.array(np.concatenate(x)) for x in out], ["q", "r", "lower", "upper"])
    return scan


def survivors(cells: DataFrame, wanted: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(q, r, upper): rows whose upper bound reaches the kth lower bound of the query over the whole file."""
    groups = max(1, -(-wanted.count() // query_rows))
    left = cells.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    steps = cells.select(F.col("b").alias("at"), F.col("d").alias("size")).distinct()
    right = (wanted.join(steps, F.col("d") == F.col("size"))
             .select(F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("g"), F.col("at").alias("b"), F.col("size").alias("d"), "q", "vec_id", "v"))
    met = kept(left.groupBy("g", "b", "d").cogroup(right.groupBy("g", "b", "d")).applyInArrow(
        _scan(k), "q long, r long, lower double, upper double"), "topk-bounds")
    order = Window.partitionBy("q").orderBy(F.col("lower").desc(), "r")
    kth = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).where(F.col("n") == k).select("q", F.col("lower").alias("kth"))
    found = kept(met.join(kth, "q", "left").where("kth is null or upper >= kth").select("q", "r", "upper"), "topk-survivors")
    dropped(met)
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = CELL_BITS, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS, step_rows: int = STEP_ROWS) -> DataFrame:
    """For each query its ``k`` rows of ``vectors`` of highest inner product: query_id, rank, vec_id, score.

    Both tables have vec_id and an array of whole numbers ``v`` (components below 2^28 in size, so that a score of
    thousands of them is exact in 64 bits); rows whose v is null or holds a null take no part, other columns are not used.
    The approximation file is written first: every component is one of 2^bits cells between the ends of its block of
    rows; copies of a vector beyond those that can be among a query's best are left out of it. Groups of queries scan it, and it alone, in steps of bounded memory: the cells' centres give each score up to
    half a cell, rows whose upper bound stays below the kth lower bound go, first within the step, then over the whole
    file. Exact vectors are read for what survives, in the order of the bounds: first FIRST * k of a query, then those whose
    bound reaches the kth score found, which settles the result. Ties go to the smaller vec_id; a query is not its own
    candidate, nor are other rows of its id; only vectors of its length are. Repeated query rows of one id and vector
    give one set of results, repeated rows of ``vectors`` are candidates each. With fewer candidates than k all are
    returned, without any none; an empty table gives no rows.
    """
    def taking_part(df):
        return df.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull())).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.size("v").alias("d"), F.col("v").cast("array<long>").alias("v"))

    number = F.monotonically_increasing_id()
    rows = kept(taking_part(vectors).select(number.alias("r"), "vec_id", "d", "v"), "topk-rows")
    exact = kept(_candidates(rows, k), "topk-exact")
    dropped(rows)
    wanted = kept(taking_part(queries).distinct().select(number.alias("q"), "vec_id", "d", "v"), "topk-queries")
    cells = kept(approximation_file(exact, bits, block_rows, step_rows), "topk-cells")
    order = Window.partitionBy("q").orderBy(F.col("upper").desc(), "r")
    ranked = kept(survivors(cells, wanted, k, query_rows).withColumn("n", F.row_number().over(order)), "topk-ranked")
    dropped(cells)
    asked = wanted.select("q", F.col("vec_id").alias("query_id"), F.col("v").alias("w"))
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)

    def scored(pairs):
        return pairs.join(exact.select("r", "vec_id", "v"), "r").join(asked, "q").select("q", "query_id", "vec_id", product.alias("score"))

    def best(rows, *by):
        place = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    first = kept(scored(ranked.where(F.col("n") <= FIRST * k)), "topk-first")
    sure = best(first, "q").where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
    rest = ranked.where(F.col("n") > FIRST * k).join(sure, "q").where("upper >= kth")
    return best(first.unionByName(scored(rest)), "query_id").select("query_id", "rank", "vec_id", "score")
