"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.storage import dropped, kept


def _forest(edges: DataFrame) -> DataFrame:
    """Within each partition's batches, edges to the smallest node of their local component instead of all edges."""
    def shrink(batches):
        import pyarrow as pa
        for batch in batches:
            parent: dict[int, int] = {}

            def root(x):
                top = x
                while parent.get(top, top) != top:
                    top = parent[top]
                while parent.get(x, x) != top:
                    parent[x], x = top, parent[x]
                return top

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            found = [(x, root(x)) for x in parent]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return edges.mapInArrow(shrink, "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of longs): the smallest node reachable.

    Alternating large-star and small-star steps: each node's larger, then smaller, neighbours are linked to the smallest
    one it knows, and each batch of links is contracted by itself, until the table is stars. Every step is an aggregate and a join on nodes, whose tables are written to
    the shared folder and read back, so a node with very many links is cut up by the skew join and nothing is
    recomputed. Links to itself and null ends are left out; an empty table gives no rows. Rounds go on until one changes
    nothing, some logarithm of the table's size; there is no limit to their number.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"`{a}` is not null and `{b}` is not null and a <> b")
    edges = kept(_forest(_forest(edges).distinct()).distinct(), label)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), label)
        large = kept(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
        dropped(least)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, kept(_forest(least.select("a", F.col("m").alias("b")).union(small).distinct()).distinct(), label)
        dropped(last, large)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(roots.select("node", F.col("node").alias("component"))))
