"""As-of joins on instants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_known(facts: DataFrame, values: DataFrame, key: Sequence[str], at: str, names: Sequence[str], part_of: Column | None = None) -> DataFrame:
    """``facts`` with the ``names`` of the newest row of ``values`` of its key at or before its own ``at``; NULL before the first.

    Both sides have the columns ``key`` and ``at``. Time is cut in slices (``part_of`` a column of ``at``; by default its day), and facts and
    values of one key and slice are put in order together, the last value carried on. What a slice begins with is the last
    value of earlier ones: of each key and slice one row is kept, so that carry is cheap, and a key with very many facts is dealt
    into as many tasks as it has slices. Of values at one instant the greatest counts (by ``names`` in order). A null key or
    instant finds nothing, and a value without them is not found; values may be null themselves. Facts may be repeated.
    """
    part = F.to_date(at) if part_of is None else part_of
    known = values.where(F.col(at).isNotNull()).select(*key, at, part.alias("_part"), F.struct(*names).alias("_value"))
    for name in key:
        known = known.where(F.col(name).isNotNull())
    own = facts.withColumn("_part", part)
    # the last value of each key and slice, and for every slice that has facts what was known before it
    ends = known.groupBy(*key, "_part").agg(F.max_by("_value", F.struct(at, "_value")).alias("_end"))
    asked = own.select(*key, "_part").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    slices = ends.unionByName(asked).groupBy(*key, "_part").agg(F.max("_end").alias("_end"), F.max(F.col("_end").isNull()).alias("_asked"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_value", F.last("_end", ignorenulls=True).over(earlier)).where("_asked").select(*key, "_part", "_value")
    rows = [f for f in facts.columns if f not in key]
    events = (own.select(*key, "_part", F.col(at).alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast(ends.schema["_end"].dataType).alias("_value"),
                         F.struct(*rows).alias("_fact"))
              .unionByName(known.select(*key, "_part", F.col(at).alias("_at"), F.lit(1).alias("_kind"), "_value",
                                        F.lit(None).alias("_fact")))
              .unionByName(carried.select(*key, "_part", F.lit(None).cast(facts.schema[at].dataType).alias("_at"), F.lit(0).alias("_kind"), "_value",
                                          F.lit(None).alias("_fact"))))
    order = Window.partitionBy(*key, "_part").orderBy(F.col("_kind") != 0, F.col("_at").asc_nulls_last(), "_kind", "_value")
    known_then = F.last("_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = events.withColumn("_known", known_then).where("_kind = 2")
    found = F.when(F.col(f"_fact.{at}").isNotNull(), F.col("_known"))
    return joined.withColumn("_known", found).select(*key, "_fact.*", *(F.col(f"_known.{n}").alias(n) for n in names))
