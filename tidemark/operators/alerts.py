"""Alert conditions as one row each: (alert, severity, fired, as_of)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.clock import ago, day, ts
from tidemark.operators import monitoring as m


def _alert(df: DataFrame, name: str, severity: str, fired: Column, as_of: dt.datetime) -> DataFrame:
    return df.agg(F.coalesce(fired, F.lit(False)).alias("fired")).select(
        F.lit(name).alias("alert"), F.lit(severity).alias("severity"), "fired", ts(as_of).alias("as_of"))


def quota_critical(monitors: DataFrame, as_of: dt.datetime, percent: float = 90.0) -> DataFrame:
    return _alert(m.quota_status(monitors), "quota_critical", "CRITICAL",
                  F.bool_or(F.col("usage_percent") >= percent), as_of)


def long_running(queries: DataFrame, as_of: dt.datetime, minutes: int = 15) -> DataFrame:
    recent = m.long_running(queries, as_of).where(F.col("start_time") >= ago(as_of, minutes=minutes))
    return _alert(recent, "long_running", "WARNING", F.count("*") > 0, as_of)


def failed_spike(queries: DataFrame, as_of: dt.datetime, minutes: int = 15, limit: int = 10) -> DataFrame:
    recent = m.failed(queries, as_of).where(F.col("start_time") >= ago(as_of, minutes=minutes))
    return _alert(recent, "failed_spike", "WARNING", F.count("*") > limit, as_of)


def high_queue(load: DataFrame, as_of: dt.datetime, limit: float = 5.0) -> DataFrame:
    return _alert(m.active_load(load, as_of), "high_queue", "WARNING",
                  F.bool_or(F.col("avg_queries_queued") > limit), as_of)


def cost_spike(metering: DataFrame, as_of: dt.datetime, factor: float = 1.2) -> DataFrame:
    this_month = F.trunc(day(as_of), "month")
    month = F.col("usage_month").cast("date")
    now = F.sum(F.when(month == this_month, F.col("total_credits")).otherwise(0))
    before = F.sum(F.when(month == F.add_months(this_month, -1), F.col("total_credits")).otherwise(0))
    return _alert(m.cost_by_month(metering, as_of), "cost_spike", "CRITICAL",
                  (now > before * F.lit(factor).cast("decimal(4,2)")) & (before > 0), as_of)
