"""Validation reports: counters with a verdict, one pass over each table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemark.functions.clock import day
from tidemark.functions.measures import ordered_case


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _verdict(ok: Column, good: str, bad: str) -> Column:
    return F.when(ok, good).otherwise(bad)


def share_by(df: DataFrame, column: str) -> DataFrame:
    """Count per value and percent of all rows; the grand total is taken over the grouped rows only."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_all"))
    # the total is one row, so this is a scalar attached to each group
    return (counts.withColumn("percentage", F.round(F.col("count") * 100.0 / total.scalar(), 2)))


def holdings_null_measures() -> list[Column]:
    c, m = F.col("cost_basis"), F.col("market_value")
    return [F.count("*").alias("total_holdings"), _n(c.isNull()).alias("null_cost_basis"),
            _n(m.isNull()).alias("null_market_value"), _n(c <= 0).alias("invalid_cost_basis"),
            _n(m <= 0).alias("invalid_market_value"),
            _verdict(_n(c.isNull() | m.isNull()) == 0, "PASS", "FAIL").alias("quality_check")]


def holdings_nulls(holdings: DataFrame) -> DataFrame:
    return holdings.agg(*holdings_null_measures())


def gain_loss_measures() -> list[Column]:
    known = F.col("cost_basis").isNotNull() & F.col("market_value").isNotNull()
    off = known & (F.abs(F.col("unrealized_pnl") - (F.col("market_value") - F.col("cost_basis"))) > 0.01)
    return [_n(known).alias("total_records"), _n(off).alias("calculation_errors"),
            _verdict(_n(off) == 0, "PASS", "WARNING").alias("validation_result")]


def gain_loss_check(holdings: DataFrame) -> DataFrame:
    return holdings.agg(*gain_loss_measures())


def orphans(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    lost = facts.join(dim.select(key), key, "left_anti")
    return lost.agg(F.count("*").alias("orphan_holdings"),
                    _verdict(F.count("*") == 0, "PASS", "FAIL").alias("validation_result"))


def date_range_measures(as_of: dt.date) -> list[Column]:
    return [F.min("as_of_date").alias("earliest_date"), F.max("as_of_date").alias("latest_date"),
            F.count_distinct("as_of_date").alias("unique_dates"),
            _verdict(F.max("as_of_date") <= day(as_of), "PASS", "FAIL").alias("date_check")]


def date_range(facts: DataFrame, as_of: dt.date) -> DataFrame:
    return facts.agg(*date_range_measures(as_of))


def value_measures() -> list[Column]:
    pnl = F.col("unrealized_pnl")
    return [F.count("*").alias("total_positions"), F.round(F.sum("cost_basis"), 2).alias("total_cost_basis"),
            F.round(F.sum("market_value"), 2).alias("total_market_value"),
            F.round(F.sum(pnl), 2).alias("total_unrealized_pnl"), F.round(F.avg("gain_loss_pct"), 4).alias("avg_return_pct"),
            _n(pnl > 0).alias("profitable_positions"), _n(pnl < 0).alias("losing_positions")]


def value_summary(holdings: DataFrame) -> DataFrame:
    return holdings.agg(*value_measures())


def nav_quality(nav: DataFrame) -> DataFrame:
    return nav.agg(
        F.count("*").alias("total_records"), _n(F.col("nav_per_share").isNull()).alias("null_nav"),
        _n(F.col("daily_return").isNull()).alias("null_daily_return"),
        F.count("alpha").alias("with_alpha"), F.count("beta").alias("with_beta"),
        F.min("as_of_date").alias("earliest_nav"), F.max("as_of_date").alias("latest_nav"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("record_count")).select(F.lit(name).alias("table_name"), "record_count")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def total_records(counts: DataFrame, target: int = 10_000, near: int = 8_000) -> DataFrame:
    total = F.sum("record_count")
    return counts.agg(total.alias("total_records"), ordered_case(
        (total >= target, "PASS"), (total >= near, "WARNING"), otherwise="FAIL").alias("validation_result"))


def count_targets(counts: DataFrame, targets: Mapping[str, int]) -> DataFrame:
    met = F.lit(False)
    for name, target in targets.items():
        met = met | ((F.col("table_name") == name) & (F.col("record_count") >= target))
    return counts.withColumn("target_check", F.when(met, "TARGET MET").otherwise("BELOW TARGET"))


def security_distribution(securities: DataFrame) -> DataFrame:
    return securities.where("is_current").groupBy("security_type").agg(
        F.count("*").alias("count"), F.count_distinct("ticker").alias("unique_tickers"),
        F.count_distinct("sector").alias("sectors"), F.count_distinct("benchmark_index").alias("benchmarks"),
        F.round(F.avg("expense_ratio"), 4).alias("avg_expense_ratio"))


def portfolio_distribution(portfolios: DataFrame) -> DataFrame:
    return portfolios.groupBy("portfolio_type", "strategy").agg(
        F.count("*").alias("count"), F.avg("management_fee").alias("avg_mgmt_fee"),
        F.avg("expense_ratio").alias("avg_expense"))


def completeness_measures(columns: Mapping[str, str]) -> list[Column]:
    return [F.count("*").alias("total_holdings"), *[
        F.round(F.count(src) * 100.0 / F.nullif(F.count("*"), F.lit(0)), 2).alias(out) for out, src in columns.items()]]


def completeness(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Percent of non-NULL values; ``columns`` maps output name to input column."""
    return df.agg(*completeness_measures(columns))


def together(df: DataFrame, reports: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Any number of one-row reports of a table in one pass over it: one row, a struct for each report."""
    return df.agg(*(F.struct(*measures).alias(name) for name, measures in reports.items()))


def measured_on_load(df: DataFrame, path: str, reports: Mapping[str, Sequence[Column]]) -> dict[str, dict]:
    """Writes the table and gives the reports of what was written, counted while it passed, without reading it again.

    Distinct counts can't be kept that way; ask for those by :func:`together`. The table is written anew.
    """
    seen = Observation()
    df.observe(seen, *(F.struct(*measures).alias(name) for name, measures in reports.items())).write.mode("overwrite").parquet(path)
    return {name: row.asDict() for name, row in seen.get.items()}


def summary_profile(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("total_records"), F.count_distinct("portfolio_id").alias("unique_portfolios"),
        F.count_distinct("security_id").alias("unique_securities"),
        F.min("as_of_date").alias("earliest_date"), F.max("as_of_date").alias("latest_date"))


def health_report(checks: Sequence[tuple[str, int, Column | int, DataFrame, str]]) -> DataFrame:
    """Rows (component, expected, actual, status, details).

    A check is (component, expected, needed, one-row DataFrame with ``actual``, details): healthy when
    ``actual`` reaches ``needed``; with ``needed`` None it must equal ``expected``.
    """
    out = None
    for name, expected, needed, measured, details in checks:
        ok = F.col("actual") == expected if needed is None else F.col("actual") >= needed
        row = measured.select(
            F.lit(name).alias("component"), F.lit(expected).cast("bigint").alias("expected"),
            F.col("actual").cast("bigint").alias("actual"),
            F.when(ok, "HEALTHY").otherwise("CHECK").alias("status"), F.lit(details).alias("details"))
        out = row if out is None else out.unionByName(row)
    return out


def unique_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count; empty when the declared key holds."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
