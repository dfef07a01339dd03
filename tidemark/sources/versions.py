"""Tables of which some partitions are replaced at once: readers see the old ones or the new ones, never a mix.

``path/rows/version=N/part=P`` holds the rows that the Nth publication wrote, ``path/live/version=N`` the partitions it replaced,
which is written last. The newest version of each partition counts. A publication that breaks off is not seen, and the next one
takes its number. One publication runs at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources import files


def live(spark: SparkSession, path: str) -> DataFrame:
    """(part, version) of the partitions that count."""
    if not files.exists(spark, f"{path}/live"):
        return spark.createDataFrame([], "part string, version int")
    return spark.read.schema("part string, version int").parquet(f"{path}/live").groupBy("part").agg(F.max("version").alias("version"))


def publish(df: DataFrame, path: str, part: str | Column, touched: DataFrame | None = None) -> int:
    """Replaces the partitions named by ``touched`` (a column ``part``), or else those that ``df`` has rows of, with its rows.

    ``part`` is a column of ``df`` or made of some. A touched partition without rows is empty from then on. ``df`` may read the table itself.
    """
    spark = df.sparkSession
    version = (live(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    rows = f"{path}/rows/version={version}"
    (df.withColumn("part", (F.col(part) if isinstance(part, str) else part).cast("string")).hint("rebalance", F.col("part")).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("part").parquet(rows))
    if touched is None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        touched = spark.read.schema(f"{fields}, part string").parquet(rows)
    touched.select("part").distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/live/version={version}")
    return version


def current(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows that count, with ``part``; a filter on ``part`` reads those folders only. Without ``schema`` that of the files is taken."""
    if schema is None:
        schema = spark.read.parquet(f"{path}/rows").drop("version", "part").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = spark.read.schema(f"{fields}, version int, part string").parquet(f"{path}/rows")
    return rows.join(live(spark, path), ["part", "version"], "left_semi").select(*(f.name for f in schema.fields), "part")
