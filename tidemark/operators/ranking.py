"""Row numbers inside groups that may be far too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_slice(value: Column, per_octave: int = 4) -> Column:
    """Slice number that rises with the value: ``per_octave`` slices for each doubling of its size."""
    size = F.log2(F.abs(value.cast("double")) + 1.0) * per_octave
    return F.coalesce(F.floor(F.signum(value.cast("double")) * size), F.lit(-(1 << 20))).cast("int")


def sliced_row_number(df: DataFrame, group: Sequence[str], by: str, tie: Sequence[str], name: str, *,
                      large: int = 1_000_000) -> DataFrame:
    """``row_number() over (partition by group order by by desc, tie)`` with large groups cut in slices.

    A group of more than ``large`` rows is partitioned by (group, slice of the value), numbered per slice,
    and each slice is shifted by the size of the higher ones. Other groups are one slice. There is at most
    one large group for each ``large`` rows, so their list is short beside the table. NULL values come last.
    One narrow pass counts rows per slice; the rows themselves are shuffled once.
    """
    counts = df.withColumn("_slice", value_slice(F.col(by))).groupBy(*group, "_slice").agg(F.count("*").alias("_rows"))
    hot = (counts.groupBy(*group).agg(F.sum("_rows").alias("_all")).where(F.col("_all") > large)
           .select(*group, F.lit(True).alias("_hot")))
    higher = Window.partitionBy(*group).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (counts.join(hot, list(group)).withColumn("_before", F.sum("_rows").over(higher))
              .select(*group, "_slice", "_before"))
    cut = df.join(hot, list(group), "left").withColumn(
        "_slice", F.when(F.col("_hot"), value_slice(F.col(by))).otherwise(0))
    within = Window.partitionBy(*group, "_slice").orderBy(F.col(by).desc_nulls_last(), *tie)
    # without the repartition an earlier join's partitioning by part of the key would be kept
    numbered = cut.repartition(*group, "_slice").withColumn("_n", F.row_number().over(within))
    return (numbered.join(shifts, [*group, "_slice"], "left")
            .withColumn(name, F.col("_n") + F.coalesce("_before", F.lit(0)))
            .drop("_hot", "_slice", "_n", "_before"))


def top_k(df: DataFrame, group: Sequence[str], by: str, tie: Sequence[str], k: int, name: str) -> DataFrame:
    """First ``k`` rows per group; Spark cuts to k per group in each map task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.col(by).desc_nulls_last(), *tie)
    return (df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
            .withColumn(name, F.col(name).cast("bigint")))
