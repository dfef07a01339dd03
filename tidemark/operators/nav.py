"""Net asset value per portfolio and day, and its returns.

Everything here is first reduced to one row per portfolio and day. Windows over a portfolio
are therefore never longer than the calendar, however many trades a portfolio has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.functions.measures import ratio, simple_return
from tidemark.operators import rolling

PERIODS = {"mtd": "month", "qtd": "quarter", "ytd": "year"}


def by_day() -> WindowSpec:
    return Window.partitionBy("portfolio_id").orderBy("as_of_date")


def nav_from_trades(trades: DataFrame) -> DataFrame:
    return trades.groupBy("portfolio_id", F.col("trade_date").alias("as_of_date")).agg(
        F.sum("net").alias("total_nav"), F.sum("quantity").alias("shares_outstanding")).withColumn(
        "nav_per_share", ratio("total_nav", "shares_outstanding"))


def with_benchmark(nav: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """Adds the NAV per share of all portfolios together that day.

    ``trades``, where given, are those that ``nav`` was summed from: summed by day alone they give the same, and NAV is not made twice.
    The market has one row per day of the calendar, whatever the portfolios, so it is broadcast; NAV stays where it is.
    """
    if trades is None:
        by_date = nav.groupBy("as_of_date").agg(F.sum("total_nav").alias("_value"), F.sum("shares_outstanding").alias("_shares"))
    else:
        by_date = trades.groupBy(F.col("trade_date").alias("as_of_date")).agg(F.sum("net").alias("_value"), F.sum("quantity").alias("_shares"))
    market = by_date.select("as_of_date", ratio("_value", "_shares").alias("benchmark_nav"))
    return nav.join(F.broadcast(market), "as_of_date", "left")


def daily_return(nav: DataFrame) -> DataFrame:
    return nav.withColumn("daily_return", simple_return("nav_per_share", F.lag("nav_per_share").over(by_day())))


def period_returns(nav: DataFrame) -> DataFrame:
    """Return since the last NAV of the previous month, quarter and year (the last one that exists)."""
    # the row before a period's first row is the last NAV of an earlier period
    previous, previous_day = F.lag("nav_per_share").over(by_day()), F.lag("as_of_date").over(by_day())
    opened = {f"_{name}": F.when(F.trunc(previous_day, unit) != F.trunc("as_of_date", unit), previous)
              for name, unit in PERIODS.items()}
    carried = by_day().rowsBetween(Window.unboundedPreceding, 0)
    returns = {f"{name}_return": simple_return("nav_per_share", F.last(f"_{name}", ignorenulls=True).over(carried))
               for name in PERIODS}
    return nav.withColumns(opened).withColumns(returns).drop(*opened)


def benchmark_return(nav: DataFrame) -> DataFrame:
    return nav.withColumn("benchmark_return",
                          simple_return("benchmark_nav", F.lag("benchmark_nav").over(by_day())))


def _beta(r: Column | str, b: Column | str) -> Column:
    return ratio(F.covar_samp(r, b), F.var_samp(b))


def alpha_beta(nav: DataFrame) -> DataFrame:
    """Per portfolio over its whole history; needs daily_return and benchmark_return."""
    paired = nav.where("daily_return IS NOT NULL AND benchmark_return IS NOT NULL")
    stats = paired.groupBy("portfolio_id").agg(
        F.count("*").alias("days"), _beta("daily_return", "benchmark_return").alias("beta"),
        F.avg("daily_return").alias("_r"), F.avg("benchmark_return").alias("_b"))
    return stats.withColumn("alpha", F.col("_r") - F.col("beta") * F.col("_b")).drop("_r", "_b")


def rolling_alpha_beta(nav: DataFrame) -> DataFrame:
    """The same over the last 60 rows of each portfolio."""
    known = rolling.trailing(nav, "portfolio_id", "as_of_date", 60, "daily_return", "benchmark_return", "_last")
    return known.withColumn("beta", ratio(rolling.covariance("_last"), rolling.variance("_last", "y"))).withColumn(
        "alpha", rolling.mean("_last", "x") - F.col("beta") * rolling.mean("_last", "y")).drop("_last")


def nav_history(nav: DataFrame) -> DataFrame:
    """All derived NAV columns, benchmark included; one shuffle, since every window has the same keys."""
    return rolling_alpha_beta(benchmark_return(period_returns(daily_return(nav))))
