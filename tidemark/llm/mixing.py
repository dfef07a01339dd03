"""Mixing sources to target weights with native column functions.

Documents get hash-random keys, fall into key ranges within their source, and are taken up to the exact place where the
running sum of their sizes reaches the source's budget: whole ranges before it, and the sorted range that holds it in
part. A budget above the source's size repeats whole epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.storage import kept, set_aside

WORD = r"[^\x20\x09-\x0D]+"
#: fixed values: the hex digits of a key that name its range; 3 give 4096 ranges a source
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: Sequence[float], cap: float, share: float = 1.0) -> DataFrame:
    """Adds ``target`` to one row per source (columns source, source_size).

    Sources ordered by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target stops
    at ``cap`` times its source's size and the excess is shared again by weight until none is above: with sources in
    order of cap / weight, the first one whose fair share of what the earlier caps left is below its own cap ends the
    capped ones. Sources without words get 0. Only this table of sources is ever ordered as a whole.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = (sources.withColumn("_rank", F.row_number().over(by_name) - 1)
             .withColumn("_weight", F.element_at(cycle, F.pmod(F.col("_rank"), F.lit(len(weights))) + 1))
             .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
             .withColumn("_ratio", F.col("_cap") / F.col("_weight")))
    upto = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_ratio", "_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (named.withColumn("_left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
              .withColumn("_level", F.col("_left") / F.sum("_weight").over(after))
              .withColumn("_open", F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))))
    return (filled.withColumn("_water", F.first("_open", ignorenulls=True).over(Window.orderBy("_ratio", "_rank").rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)))
            .withColumn("target", F.when(F.col("_water").isNull() | (F.col("_ratio") <= F.col("_water")), F.col("_cap"))
                        .otherwise(F.col("_weight") * F.col("_water")))
            .select("source", "source_size", "target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, share: float = 1.0, seed: str = "") -> DataFrame:
    """``docs`` with _size, _source_size, _target and _taken (words the mix takes, repeats counted).

    A document's key is the MD5 of its id and ``seed``, so reruns agree. Its first digits are its key range: sizes are
    summed over the documents of one source and range, and those sums over the ranges before. Only the range that holds a
    source's cut is sorted, and sums before each of its documents; a document of any other is taken as a whole or not at
    all, for which it meets its range's row and need not be shuffled as long as those rows, written on the way, are few.
    Per source floor(target) words are taken: whole epochs, and in the last one documents in key order; the document at the cut is taken in part. Null texts
    have size 0 and nothing is taken of them. Equal ids are told apart by size; equal rows share what they are given in
    any order. Null ids count as one more id. Source null is a source of its own.
    """
    docs, restore = set_aside(docs, ["doc_id", "text", "source"], ["_size", "_source_size", "_target", "_taken"])
    docs = docs.withColumn("_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)).cast("binary")))
    docs = docs.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    ranges = kept(docs.groupBy(F.col("source").alias("_s"), F.col("_range").alias("_r")).agg(F.sum(word_count(F.col("text"))).alias("_in_range")), "mix-ranges")
    sources = targets(ranges.groupBy(F.col("_s").alias("source")).agg(F.sum("_in_range").alias("source_size")), weights, cap, share)
    sources = sources.select(F.col("source").alias("_t"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_ahead", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
    ranges = ranges.join(sources, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    budget = F.floor(F.col("_target"))
    size = F.col("_source_size")
    epochs = F.when(size > 0, F.floor(budget / F.greatest(size, F.lit(1)))).otherwise(F.lit(0))
    ranges = ranges.withColumns({"_epochs": epochs, "_rest": budget - epochs * size})
    is_cut = (F.col("_rest") > F.col("_ahead")) & (F.col("_rest") < F.col("_ahead") + F.col("_in_range"))
    ranges = kept(ranges.withColumn("_cut", F.coalesce(is_cut, F.lit(False))), "mix-ranges")

    def placed(own: DataFrame) -> DataFrame:
        joined = docs.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        return joined.withColumn("_size", word_count(F.col("text")))

    whole = placed(ranges.where("not _cut")).withColumn("_partial", F.when(F.col("_rest") > F.col("_ahead"), F.col("_size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_ahead") - F.coalesce(F.sum("_size").over(inside), F.lit(0))
    cut = placed(ranges.where("_cut")).withColumn("_partial", F.least(F.greatest(left, F.lit(0)), F.col("_size")))
    both = whole.unionByName(cut)
    return restore(both.withColumn("_taken", (F.col("_epochs") * F.col("_size") + F.col("_partial")).cast("long")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: a document is there once for each epoch that takes of it.

    The document at a source's cut is kept whole. Documents nothing is taken of go, among them those without words.
    """
    docs, restore = set_aside(docs, ["doc_id", "text", "source"], [])
    mixed = mix(docs, **how)
    times = F.when(F.col("_taken") > 0, F.ceil(F.col("_taken") / F.greatest(F.col("_size"), F.lit(1)))).otherwise(F.lit(0)).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return restore(mixed.withColumn("_copy", F.explode(copies)))
