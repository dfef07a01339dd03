"""Calendar and security dimension columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.clock import day, is_trading_day
from tidemark.functions.measures import ordered_case, pick

# fixed values: bucket lists, in bucket order
EXCHANGES = ["NYSE", "NASDAQ", "AMEX"]
STOCK_INDEXES = ["SPX", "NDX", "RUT"]
RATINGS = ["LOW", "LOW-MEDIUM", "MEDIUM", "MEDIUM-HIGH", "HIGH"]
FUND_MANAGERS = ["John Smith", "Sarah Johnson", "Michael Chen", "Emily Davis", "Robert Wilson", "Jennifer Lee",
                 "David Brown", "Lisa Anderson"]
FUND_MINIMUMS = [1000, 2500, 3000, 5000]
PORTFOLIO_TYPES = ["MUTUAL_FUND", "HEDGE_FUND", "SMA", "ETF", "PENSION"]
STRATEGIES = ["GROWTH", "VALUE", "BALANCED", "INCOME", "INDEX", "MOMENTUM", "DIVIDEND", "MULTI_STRATEGY"]
PORTFOLIO_MINIMUMS = [10000, 25000, 50000, 100000]


def dim_date(spark: SparkSession, start: dt.date, days: int, as_of: dt.date, holidays: DataFrame | None = None) -> DataFrame:
    """``days`` calendar days from ``start``, none after ``as_of``.

    Trading days are weekdays, less the dates of ``holidays`` (calendar_date) when given.
    """
    last = F.least(F.date_add(day(start), days - 1), day(as_of))
    dates = spark.range(1).select(F.explode(F.when(day(start) <= last, F.sequence(day(start), last))).alias("calendar_date"))
    d = F.col("calendar_date")
    month_end = d == F.last_day(d)
    out = dates.select(
        F.date_format(d, "yyyyMMdd").cast("bigint").alias("date_key"), d, F.year(d).cast("bigint").alias("year"),
        F.quarter(d).cast("bigint").alias("quarter"), F.month(d).cast("bigint").alias("month"),
        F.monthname(d).alias("month_name"), F.weekofyear(d).cast("bigint").alias("week_of_year"),
        (F.dayofweek(d) - 1).cast("bigint").alias("day_of_week"), F.dayname(d).alias("day_name"),
        (~is_trading_day(d)).alias("is_weekend"), is_trading_day(d).alias("is_us_trading_day"),
        month_end.alias("is_month_end"), (month_end & F.month(d).isin(3, 6, 9, 12)).alias("is_quarter_end"),
        ((F.month(d) == 12) & (F.dayofmonth(d) == 31)).alias("is_year_end"),
        F.year(d).cast("bigint").alias("fiscal_year"), F.quarter(d).cast("bigint").alias("fiscal_quarter"))
    if holidays is not None:
        closed = holidays.select("calendar_date", F.lit(True).alias("_closed"))
        out = (out.join(closed, "calendar_date", "left")
               .withColumn("is_us_trading_day", F.col("is_us_trading_day") & F.col("_closed").isNull())
               .select("date_key", "calendar_date", *[c for c in out.columns if c not in ("date_key", "calendar_date")]))
    return out


def trading_days(calendar: DataFrame, as_of: dt.date, *, days: int = 0, months: int = 0) -> DataFrame:
    """Trading days of the look-back that ends at ``as_of``."""
    since = F.add_months(day(as_of), -months) if months else F.date_sub(day(as_of), days)
    return calendar.where(F.col("is_us_trading_day") & F.col("calendar_date").between(since, day(as_of))).select("calendar_date")


def stock_style(sector: Column) -> Column:
    return ordered_case((sector == "Technology", "LARGE_CAP_GROWTH"), (sector == "Financials", "LARGE_CAP_VALUE"),
                        (sector == "Healthcare", "LARGE_CAP_BLEND"), otherwise="LARGE_CAP_BLEND")


def fund_asset_class(category: Column) -> Column:
    return ordered_case((category.like("%Bond%"), "FIXED_INCOME"),
                        (category.like("%International%") | category.like("%Emerging%"), "INTERNATIONAL_EQUITY"),
                        otherwise="EQUITY")


def fund_index(category: Column) -> Column:
    return ordered_case((category.like("%Growth%"), "RLG"), (category.like("%Value%"), "RLV"),
                        (category.like("%Bond%"), "LBUSTRUU"), (category.like("%International%"), "MXWO"),
                        (category.like("%Emerging%"), "MXEF"), otherwise="SPX")


def digest_number(text: Column) -> Column:
    """A number below 2**32 taken from the text's MD5: the same in every run and engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10)


def security_keys(df: DataFrame, prefix: str, number: str, ticker: str, name: str, letters: int = 26) -> DataFrame:
    """Prefixed ids, ISIN- and CUSIP-like codes, numbered tickers and lettered series names."""
    n, t = F.col(number), F.col(ticker)
    series = F.chr(F.lit(65) + F.pmod(n, F.lit(letters)))
    return df.withColumns({
        "security_id": F.concat(F.lit(prefix), F.lpad(n.cast("string"), 5, "0")),
        "isin": F.concat(F.lit("US"), F.lpad(digest_number(F.concat(t, n.cast("string"))), 10, "0")),
        "cusip": F.lpad(digest_number(t), 9, "0"),
        "ticker": F.concat(t, F.when(n > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise("")),
        "security_name": F.concat(F.col(name), F.when(n > 0, F.concat(F.lit(" Series "), series)).otherwise("")),
    })


def assign_buckets(df: DataFrame, number: str) -> DataFrame:
    """Attributes picked from fixed lists by row number; negative numbers wrap."""
    n = F.col(number)
    return df.withColumns({
        "exchange": pick(EXCHANGES, n), "benchmark_index": pick(STOCK_INDEXES, n), "risk_rating": pick(RATINGS, n),
        "fund_manager": pick(FUND_MANAGERS, n), "min_investment": pick(FUND_MINIMUMS, n),
        "portfolio_type": pick(PORTFOLIO_TYPES, n), "strategy": pick(STRATEGIES, n),
        "portfolio_minimum": pick(PORTFOLIO_MINIMUMS, n)})
