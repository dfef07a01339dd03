"""Folders of any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder; no file is opened."""
    system, where = _at(spark, path)
    return system.getContentSummary(where).getLength()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    system, where = _at(spark, pattern)
    return [str(s.getPath().toString()) for s in system.globStatus(where) or []]


def make_folder(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.mkdirs(where)


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)
