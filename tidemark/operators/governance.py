"""Policies applied to tables, and reports over tags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.clock import ts
from tidemark.functions.measures import ordered_case
from tidemark.functions.policies import MASK_FOR_TAG, MASKS, ROW_FILTERS

LEVELS = ["database", "schema", "table", "column"]


def governed(df: DataFrame, role: str, masks: Mapping[str, str] = {}, filters: Mapping[str, str] = {}) -> DataFrame:
    """The table as ``role`` sees it: row filters first, on the unmasked values, then column masks.

    ``masks`` and ``filters`` map a column to a policy name.
    """
    for column, policy in filters.items():
        df = df.where(ROW_FILTERS[policy](F.col(column), role))
    return df.withColumns({c: MASKS[p](F.col(c), role) for c, p in masks.items()}) if masks else df


def mask_by_tag(df: DataFrame, role: str, classification: Mapping[str, str]) -> DataFrame:
    """Masks each column by its PII classification (column -> tag value)."""
    masked = {c: MASK_FOR_TAG[v](F.col(c), role) for c, v in classification.items() if v in MASK_FOR_TAG}
    return df.withColumns(masked) if masked else df


def column_classification(tags: DataFrame, database: str, schema: str, table: str, most: int = 2000) -> dict[str, str]:
    """PII tag per column of one table, read on the driver: at most one row per column of that table."""
    rows = tags.where((F.col("object_database") == database) & (F.col("object_schema") == schema)
                      & (F.col("object_name") == table) & (F.col("tag_name") == "PII_CLASSIFICATION")
                      & F.col("column_name").isNotNull()).select("column_name", "tag_value").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{database}.{schema}.{table} has more than {most} tagged columns")
    return {r["column_name"]: r["tag_value"] for r in rows}


def effective_tags(columns: DataFrame, tags: DataFrame, tag_name: str) -> DataFrame:
    """Tag value in force per column: its own, else its table's, its schema's or its database's.

    ``columns`` has (object_database, object_schema, object_name, column_name); ``tags`` the same plus
    (tag_name, tag_value), NULL below the level a tag is set on. A level with several values takes the smallest.
    """
    path = ["object_database", "object_schema", "object_name", "column_name"]
    out = columns
    mine = tags.where(F.col("tag_name") == tag_name)
    for depth, level in enumerate(LEVELS, start=1):
        here = mine
        for c in path[:depth]:
            here = here.where(F.col(c).isNotNull())
        for c in path[depth:]:
            here = here.where(F.col(c).isNull())
        out = out.join(here.groupBy(*path[:depth]).agg(F.min("tag_value").alias(f"_{level}")), path[:depth], "left")
    nearest = [F.col(f"_{level}") for level in reversed(LEVELS)]
    source = ordered_case(*[(F.col(f"_{level}").isNotNull(), level) for level in reversed(LEVELS)])
    return (out.withColumns({"tag_value": F.coalesce(*nearest), "tag_level": source})
            .drop(*[f"_{level}" for level in LEVELS]))


def tag_catalogue(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("tag_database") == "INV_GOVERNANCE_DB").groupBy("tag_name", "tag_value").agg(
        F.count("*").alias("objects"), F.count_distinct("object_database").alias("databases"),
        F.min("object_name").alias("first_object"))


def retention_months(policy: Column) -> Column:
    """Months a policy keeps a row; NULL keeps it for ever."""
    return ordered_case((policy == "7_YEARS", 84), (policy == "10_YEARS", 120), (policy == "1_YEAR", 12))


def retention_expired(df: DataFrame, policy: Column | str, created: str, as_of: dt.datetime) -> DataFrame:
    """Rows past their retention period."""
    rule = F.lit(policy) if isinstance(policy, str) else policy
    return df.where(F.col(created) + F.make_ym_interval(F.lit(0), retention_months(rule)) < ts(as_of))
