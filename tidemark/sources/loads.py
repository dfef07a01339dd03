"""Writing tables: conforming to a contract, full reloads, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.contracts import Contract
from tidemark.functions.clock import day
from tidemark.sources import versions


def conform(df: DataFrame, contract: Contract, business_key: Sequence[str] = ()) -> DataFrame:
    """Exactly the contract's columns, in order and type.

    Missing columns take their default, or NULL; the surrogate key is a hash of ``business_key``, so a
    re-run gives the same keys.
    """
    have = set(df.columns)
    out: list[Column] = []
    for f in contract.schema.fields:
        default = F.lit(contract.defaults.get(f.name))
        if f.name == contract.surrogate and business_key:
            value = F.xxhash64(*business_key)
        elif f.name in have:
            value = F.col(f.name) if f.name not in contract.defaults else F.coalesce(F.col(f.name), default.cast(f.dataType))
        else:
            value = default
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def missing_required(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows that break a NOT NULL column of the contract."""
    lacking = F.lit(False)
    for name in contract.required:
        lacking = lacking | F.col(name).isNull()
    return df.where(lacking)


def positional(df: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Columns matched by position, as INSERT ... SELECT does; source names are ignored."""
    if len(df.columns) != len(target_columns):
        raise ValueError(f"{len(df.columns)} columns for {len(target_columns)} targets")
    return df.toDF(*target_columns)


def full_reload(df: DataFrame, path: str, target_columns: Sequence[str], partition: str | None = None) -> None:
    """Replaces the table, or with ``partition`` only the partitions that ``df`` holds; readers see it before or after, nothing between.

    Rows are gathered per partition value before the write, but in several tasks when a value is large
    (REBALANCE splits by size), so a table does not break into one small file per task and day.
    """
    versions.publish(positional(df, target_columns), path, partition or F.lit("all"))


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`full_reload` wrote last."""
    return versions.current(spark, path).drop("part")


def write_snapshot(df: DataFrame, path: str, snapshot_date: str) -> None:
    """Stores a dated copy; a repeated run replaces that date only."""
    (df.withColumn("snapshot_date", day(snapshot_date)).write.partitionBy("snapshot_date")
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def read_snapshot(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The latest copy taken on or before ``as_of``; only its partition is read."""
    copies = spark.read.parquet(path)
    taken = copies.where(F.col("snapshot_date") <= day(as_of)).agg(F.max("snapshot_date"))
    return copies.where(F.col("snapshot_date") == taken.scalar())
