"""Landing raw feeds: typed price files and JSON records kept as they came."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.clock import ts

PRICE_FEED = ("security_id string, price_date date, open_price decimal(18,6), high_price decimal(18,6), "
              "low_price decimal(18,6), close_price decimal(18,6), adjusted_close decimal(18,6), volume bigint, currency string")


def land_prices(spark: SparkSession, path: str | list[str], source_system: str, loaded_at: dt.datetime, file_format: str = "json",
                schema: str = PRICE_FEED, **options: str) -> DataFrame:
    """Typed price rows (json, csv, parquet or orc; the schema is given, never inferred) with their origin."""
    reader = spark.read.schema(schema).options(**options)
    return reader.format(file_format).load(path).select(
        F.xxhash64("security_id", "price_date", F.lit(source_system), "_metadata.file_path").alias("record_id"), "*",
        F.lit(source_system).alias("source_system"), F.col("_metadata.file_path").alias("source_file"),
        ts(loaded_at).alias("load_timestamp"))


def land_json(spark: SparkSession, path: str | list[str], source_system: str, loaded_at: dt.datetime,
              side_columns: Mapping[str, tuple[str, str]] = {}) -> DataFrame:
    """One row per JSON line: ``raw_data`` as VARIANT beside the untouched ``raw_text``.

    Text that is not JSON keeps its line with a NULL ``raw_data``. ``side_columns`` maps a typed column to
    (JSON path, type).
    """
    landed = spark.read.text(path).select(F.col("value").alias("raw_text"), F.col("_metadata.file_path").alias("source_file"))
    raw = F.try_parse_json("raw_text")
    typed = [F.try_variant_get(raw, p, kind).alias(name) for name, (p, kind) in side_columns.items()]
    return landed.select(F.xxhash64("raw_text", "source_file").alias("record_id"), raw.alias("raw_data"), "raw_text", *typed,
                         F.lit(source_system).alias("source_system"), ts(loaded_at).alias("load_timestamp"), "source_file")


def export_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """Adds rows as compressed JSON lines, NULL fields included; ``by`` names a column that gives folders and stays out of the lines."""
    line = F.to_json(F.struct(*(c for c in df.columns if c != by)), {"ignoreNullFields": "false"})
    lines = df.select(line.alias("value"), *([by] if by else []))
    writer = lines.write.mode("append").option("compression", "gzip")
    (writer.partitionBy(by) if by else writer).text(path)
