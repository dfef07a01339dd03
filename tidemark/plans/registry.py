"""Named queries over a folder of test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Registers ``fn(tables) -> DataFrame`` under ``name``."""
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def plain(df: DataFrame, **digits: int | None) -> DataFrame:
    """Decimals as double, and computed doubles cut to ``digits``, so engines can be compared.

    None cuts to single precision: for averages of prices, whose last decimal is often exactly a 5.
    """
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in digits and digits[f.name] is None:
            out[f.name] = F.col(f.name).cast("float").cast("double")
        elif f.name in digits:
            out[f.name] = F.round(F.col(f.name).cast("double"), digits[f.name])
        elif kind.startswith("decimal"):
            out[f.name] = F.col(f.name).cast("double")
    return df.withColumns(out) if out else df
