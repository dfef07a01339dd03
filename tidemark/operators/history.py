"""Slowly changing dimensions (type 2): building, merging, reading at a date.

Changes are first reduced to the last one per key and day. A key's versions are then no more than
its days, so windows per key stay small even when one key has a third of all changes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.contracts import OPEN_END
from tidemark.functions.clock import day, trunc
from tidemark.sources.versions import current as published, publish


def _versions(states: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """states: at most one row per key and effective_from."""
    w = Window.partitionBy(key).orderBy("effective_from")
    state = F.struct(*attributes)
    first = F.lag("effective_from").over(w).isNull()
    changed = states.withColumn("_new", first | ~F.lag(state).over(w).eqNullSafe(state)).where("_new").drop("_new")
    until = F.lead("effective_from").over(w)
    return changed.select(key, *attributes, "effective_from",
                          F.coalesce(until, F.lit(OPEN_END).cast("timestamp_ntz")).alias("effective_to"),
                          until.isNull().alias("is_current"))


def last_per_grain(changes: DataFrame, key: str, attributes: Sequence[str], at: str, tie: str, grain: str = "day") -> DataFrame:
    when = trunc(grain, at).alias("effective_from")
    last = F.max_by(F.struct(*attributes), F.struct(at, tie)).alias("_s")
    return changes.groupBy(key, when).agg(last).select(key, "effective_from", *[F.col(f"_s.{a}").alias(a) for a in attributes])


def scd2_build(changes: DataFrame, key: str, attributes: Sequence[str], at: str, tie: str, grain: str = "day") -> DataFrame:
    """Versions with half-open validity from a change log; repeats of the same state are merged."""
    return _versions(last_per_grain(changes, key, attributes, at, tie, grain), key, attributes)


def scd2_merge(versions: DataFrame, changes: DataFrame, key: str, attributes: Sequence[str], at: str, tie: str,
               grain: str = "day") -> DataFrame:
    """The dimension after more changes, late ones included. Keys without changes pass through."""
    news = last_per_grain(changes, key, attributes, at, tie, grain)
    touched = news.select(key).distinct()
    old = versions.join(touched, key, "left_semi").select(key, "effective_from", *attributes, F.lit(0).alias("_o"))
    both = old.unionByName(news.withColumn("_o", F.lit(1))).groupBy(key, "effective_from").agg(
        F.max_by(F.struct(*attributes), "_o").alias("_s"))
    states = both.select(key, "effective_from", *[F.col(f"_s.{a}").alias(a) for a in attributes])
    rebuilt = _versions(states, key, attributes)
    return versions.join(touched, key, "left_anti").select(rebuilt.columns).unionByName(rebuilt)


def key_bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_dimension(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Replaces the whole dimension, cut in key buckets."""
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("string").alias("part"))
    publish(rows, path, key_bucket(key, buckets), every)


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    return published(spark, path).drop("part")


def merge_into_dimension(spark: SparkSession, path: str, changes: DataFrame, key: str, attributes: Sequence[str], at: str,
                         tie: str, buckets: int, grain: str = "day") -> None:
    """Replaces only the key buckets that have changes, all at once: a merge that breaks off between buckets is not seen."""
    hit = changes.select(key_bucket(key, buckets).cast("string").alias("part")).distinct()
    table = published(spark, path).join(hit, "part", "left_semi").drop("part")
    publish(scd2_merge(table, changes, key, attributes, at, tie, grain), path, key_bucket(key, buckets), hit)


def current(dimension: DataFrame) -> DataFrame:
    return dimension.where("is_current")


def point_in_time(facts: DataFrame, versions: DataFrame, key: str, at: str, as_of: dt.date, grain: str = "month") -> DataFrame:
    """Facts with the version valid at ``at``; facts without one are dropped.

    Both sides meet on (key, month): a version is repeated for the months it covers, so a fact is compared
    only with the few versions of its month, and a key with very many facts is spread over months. Dates
    after ``as_of`` share its month, which bounds the repeats of open versions; the interval test still decides.
    """
    def slot(c):
        return F.trunc(F.least(c.cast("date"), day(as_of)), grain)

    covered = F.sequence(slot(F.col("effective_from")), slot(F.col("effective_to") - F.expr("interval 1 microsecond")),
                         F.expr(f"interval 1 {grain}"))
    sliced = versions.withColumn("_slot", F.explode(covered))
    valid = (F.col(at) >= F.col("effective_from")) & (F.col(at) < F.col("effective_to"))
    return facts.withColumn("_slot", slot(F.col(at))).join(sliced, [key, "_slot"]).where(valid).drop("_slot")
