"""Refreshing rolling features after late, changed or withdrawn rows, without computing the rest again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

STALE = "_stale"


def halo(rows: DataFrame, changed: DataFrame, entity: str, date: str, depth: int) -> DataFrame:
    """The rows that must be read to renew what ``changed`` (entity, date) made stale; STALE marks those that are stale.

    A value depends on its own row and the ``depth`` - 1 before it, so a changed row makes itself and the ``depth`` - 1 after it stale, and
    a row that is no longer there those after it. The first stale row needs ``depth`` - 1 rows before it. Only entities with
    a change are looked at; a group has one row per date and so at most a calendar.
    """
    keys = changed.select(entity, date).where(F.col(entity).isNotNull()).distinct()
    touched = rows.join(keys.select(entity).distinct(), entity, "left_semi")
    marks = (touched.select(entity, date, F.lit(1).alias("here"), F.lit(0).alias("moved"))
             .unionByName(keys.select(entity, date, F.lit(0).alias("here"), F.lit(1).alias("moved")))
             .groupBy(entity, date).agg(F.max("here").alias("here"), F.max("moved").alias("moved")))
    order = Window.partitionBy(entity).orderBy(date)
    so_far, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    placed = marks.withColumn("place", F.sum("here").over(so_far))
    start = F.when(F.col("moved") == 1, F.col("place") + 1 - F.col("here"))
    ranged = placed.withColumns({"last": F.max(start).over(so_far), "next": F.min(start).over(on)}).where("here = 1")
    stale = F.coalesce(F.col("place") <= F.col("last") + (depth - 1), F.lit(False))
    wanted = ranged.withColumn(STALE, stale).where(F.col(STALE) | (F.col("place") >= F.col("next") - (depth - 1))).select(entity, date, STALE)
    return touched.join(wanted, [entity, date])


def renewed(rows: DataFrame, changed: DataFrame, features: Callable[[DataFrame], DataFrame], entity: str, date: str, depth: int) -> DataFrame:
    """The stale rows with their features as a full run would give them; ``features`` looks back at most ``depth`` rows, its own included."""
    return features(halo(rows, changed, entity, date, depth)).where(STALE).drop(STALE)


def merged(old: DataFrame, new: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows that ``new`` renews and without those of ``changed`` that are gone, and ``new``."""
    replaced = new.select(*keys).unionByName(changed.select(*keys)).distinct()
    return old.join(replaced, keys, "left_anti").unionByName(new.select(old.columns))
