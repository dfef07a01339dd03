"""Samples that a rerun repeats: rows are chosen by a hash of their key, not by a generator's state.

The hash is the first 15 hexadecimal digits of the MD5 of the salt and the key's values, so any engine can draw the same sample.
Rows of one key are alike to these functions: they are taken together by share, and put in order by their other columns
where order matters. Null key values count as the text ``null``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BITS = 60


def key_hash(key: Sequence[str], salt: str = "") -> Column:
    """A number below 2 ** 60."""
    text = F.concat_ws("|", F.lit(salt), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def in_share(key: Sequence[str], share: float, salt: str = "") -> Column:
    """Whether the key's hash lies in the lowest ``share`` of all hashes. A smaller share of the same salt lies within a larger one."""
    return key_hash(key, salt) < int(share * (1 << BITS))


def bernoulli(df: DataFrame, key: Sequence[str], share: float, salt: str = "") -> DataFrame:
    """The rows :func:`in_share`."""
    return df.where(in_share(key, share, salt))


def random_order(df: DataFrame, key: Sequence[str], k: int, salt: str = "") -> DataFrame:
    """The first ``k`` rows in random order, with their ``place`` from 1. Every map task keeps its own first ``k``; nothing is sorted whole."""
    ties = [c for c in df.columns if c not in key]
    first = df.withColumn("_hash", key_hash(key, salt)).orderBy("_hash", *key, *ties).limit(k)
    # at most k rows are left, so numbering them needs no partitions
    return first.withColumn("place", F.row_number().over(Window.orderBy("_hash", *key, *ties)).cast("bigint")).drop("_hash")


def random_per_group(df: DataFrame, strata: Sequence[str], key: Sequence[str], k: int, salt: str = "") -> DataFrame:
    """``k`` random rows of each group (all of a smaller one), with their ``place`` from 1. Groups are cut to ``k`` rows in every map task
    before the shuffle, so one that holds a third of all rows is no larger than others after it."""
    ties = [c for c in df.columns if c not in (*strata, *key)]
    order = Window.partitionBy(*strata).orderBy("_hash", *key, *ties)
    drawn = df.withColumn("_hash", key_hash(key, salt)).withColumn("place", F.row_number().over(order).cast("bigint"))
    return drawn.where(F.col("place") <= k).drop("_hash")
