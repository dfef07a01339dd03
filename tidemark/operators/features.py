"""Technical and portfolio features.

Inputs have one row per security (or portfolio) and day, so a group is never longer than the calendar.
All windows of a function share their keys: one shuffle and one sort.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.functions.clock import day_number
from tidemark.functions.measures import TRADING_DAYS, dbl, ratio, simple_return
from tidemark.operators import rolling
from tidemark.operators.ranking import top_k


def by_date(entity: str = "security_id", date: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(date)


def last_n(n: int, **names: str) -> WindowSpec:
    return by_date(**names).rowsBetween(1 - n, 0)


def returns(prices: DataFrame) -> DataFrame:
    before = F.lag("close_price").over(by_date())
    return prices.withColumns({"daily_return": simple_return("close_price", before),
                               "log_return": F.ln(ratio("close_price", before))})


def sma(prices: DataFrame, spans: tuple[int, ...] = (5, 20, 50, 200)) -> DataFrame:
    return prices.withColumns({f"sma_{n}": F.avg("close_price").over(last_n(n)) for n in spans})


def volatility(prices: DataFrame, spans: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Needs daily_return."""
    return prices.withColumns({f"volatility_{n}d": F.stddev_samp("daily_return").over(last_n(n)) for n in spans})


def rsi(prices: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength from simple means of gains and losses over ``n`` rows; 100 without losses."""
    change = F.col("close_price") - F.lag("close_price").over(by_date())
    moved = prices.withColumn("_change", change)
    gain = F.avg(F.greatest("_change", F.lit(0.0))).over(last_n(n))
    loss = F.avg(F.greatest(-F.col("_change"), F.lit(0.0))).over(last_n(n))
    known = F.count("_change").over(last_n(n))
    return (moved.withColumns({"_gain": gain, "_loss": loss, "_known": known})
            .withColumn(f"rsi_{n}", F.when(F.col("_known") > 0, F.when(F.col("_loss") == 0, 100.0).otherwise(
                100.0 - 100.0 / (1.0 + ratio("_gain", "_loss")))))
            .drop("_change", "_gain", "_loss", "_known"))


def volume(prices: DataFrame, n: int = 20) -> DataFrame:
    mean = F.avg("volume").over(last_n(n))
    return prices.withColumns({f"volume_sma_{n}": mean, "volume_ratio": ratio("volume", mean)})


def range_52w(prices: DataFrame) -> DataFrame:
    """Highest high and lowest low of 364 calendar days, and distance from the high."""
    w = Window.partitionBy("security_id").orderBy("_day").rangeBetween(-363, 0)
    out = prices.withColumn("_day", day_number("trade_date")).withColumns(
        {"high_52w": F.max("high_price").over(w), "low_52w": F.min("low_price").over(w)})
    return out.withColumn("pct_from_high", simple_return("close_price", "high_52w")).drop("_day")


def ema_macd(prices: DataFrame, spans: tuple[int, int] = (12, 26), signal: int = 9) -> DataFrame:
    """Exponential averages seeded by the first price, MACD and its signal line.

    Each value depends on the one before, which no window expresses; pandas runs over the bars of one
    security, at most one per day. Only the three needed columns go to Python.
    """
    short, long = spans

    def smooth(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("trade_date")
        fast = bars["close_price"].ewm(span=short, adjust=False).mean()
        slow = bars["close_price"].ewm(span=long, adjust=False).mean()
        macd = fast - slow
        return pd.DataFrame({"security_id": bars["security_id"], "trade_date": bars["trade_date"],
                             "close_price": bars["close_price"], f"ema_{short}": fast, f"ema_{long}": slow,
                             "macd": macd, "macd_signal": macd.ewm(span=signal, adjust=False).mean()})

    key = prices.schema["security_id"].dataType.simpleString()
    schema = (f"security_id {key}, trade_date date, close_price double, ema_{short} double, ema_{long} double, "
              "macd double, macd_signal double")
    return (prices.where("close_price IS NOT NULL").select("security_id", "trade_date", dbl("close_price").alias("close_price"))
            .groupBy("security_id").applyInPandas(smooth, schema))


def price_features(prices: DataFrame) -> DataFrame:
    """All technical features per security and day."""
    windowed = range_52w(volume(rsi(volatility(sma(returns(prices))))))
    smoothed = ema_macd(prices).drop("close_price")
    return (windowed.join(smoothed, ["security_id", "trade_date"], "left")
            .withColumnRenamed("trade_date", "feature_date"))


# --- portfolios -----------------------------------------------------------------------------------

def composition(holdings: DataFrame, sectors: DataFrame) -> DataFrame:
    """Positions, share of the five and ten largest, and sector concentration (sum of squared shares)."""
    day = ["portfolio_id", "as_of_date"]
    totals = holdings.groupBy(*day).agg(F.count("*").alias("num_positions"), F.sum("market_value").alias("_total"))
    largest = top_k(holdings.select(*day, "security_id", "market_value"), day, "market_value", ["security_id"], 10, "_rank")
    top = largest.groupBy(*day).agg(F.sum(F.when(F.col("_rank") <= 5, F.col("market_value"))).alias("_top5"),
                                    F.sum("market_value").alias("_top10"))
    per_sector = (holdings.join(sectors, "security_id").groupBy(*day, "sector").agg(F.sum("market_value").alias("_mv"))
                  .groupBy(*day).agg(F.sum(dbl("_mv") * dbl("_mv")).alias("_squares"), F.sum("_mv").alias("_all")))
    return totals.join(top, day).join(per_sector, day, "left").select(
        *day, "num_positions", ratio("_top5", "_total").alias("concentration_top5"),
        ratio("_top10", "_total").alias("concentration_top10"),
        ratio("_squares", dbl("_all") * dbl("_all")).alias("sector_hhi"))


def portfolio_returns(nav: DataFrame, spans: tuple[int, ...] = (1, 5, 20, 60)) -> DataFrame:
    w = by_date("portfolio_id", "as_of_date")
    return nav.withColumns({f"return_{n}d": simple_return("nav_per_share", F.lag("nav_per_share", n).over(w)) for n in spans})


def portfolio_risk(nav: DataFrame) -> DataFrame:
    """Volatility, Sharpe ratio and beta over trailing rows; needs daily_return and benchmark_return."""
    by = ("portfolio_id", "as_of_date")
    # in two steps, so that what is carried of one does not widen the sorts of the other
    short = rolling.trailing(nav, *by, 20, "daily_return", None, "_20").withColumn(
        "volatility_20d", F.sqrt(rolling.variance("_20", "x"))).drop("_20")
    last = rolling.trailing(short, *by, 60, "daily_return", "benchmark_return", "_60")
    vol = F.sqrt(rolling.variance("_60", "x"))
    return last.withColumns({
        "volatility_60d": vol,
        "sharpe_60d": ratio(rolling.mean("_60", "x") * float(TRADING_DAYS), vol * float(TRADING_DAYS) ** 0.5),
        "beta_to_benchmark": ratio(rolling.covariance("_60"), rolling.variance("_60", "y"))}).drop("_60")


def max_drawdown(nav: DataFrame, n: int = 60) -> DataFrame:
    """Worst fall from a peak inside the last ``n`` rows (zero or negative); rows without a value count as rows only.

    Peak, trough and worst fall of a run follow from those of its two halves, so rows are cut in blocks of ``n`` and both the run
    from a block's start to a row and that from a row to the block's end are kept up as rows pass. The last ``n`` rows are the end of one
    block and the start of the next: three values merged, whatever ``n``. All sorts share one shuffle.
    """
    series, v = by_date("portfolio_id", "as_of_date"), F.col("nav_per_share")
    fall = lambda low, high: F.try_divide(low, high) - 1.0
    cut = nav.withColumn("_row", F.row_number().over(series) - 1).withColumn("_block", F.floor(F.col("_row") / n))
    block = Window.partitionBy("portfolio_id", "_block")
    on = block.orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)
    back = block.orderBy(F.col("as_of_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    runs = (cut.withColumns({"_high": F.max(v).over(on), "_low": F.min(v).over(on)})
            .withColumn("_worst", F.min(fall(v, F.col("_high"))).over(on))
            .withColumns({"_high_after": F.max(v).over(back), "_low_after": F.min(v).over(back)})
            .withColumn("_worst_after", F.min(fall(F.col("_low_after"), v)).over(back)))
    both = runs.withColumn("_end", F.lag(F.struct("_worst_after", "_high_after"), n - 1).over(series))
    whole = F.col("_row") % n == n - 1
    merged = F.when(whole | (F.col("_block") == 0), F.col("_worst")).otherwise(
        F.least("_worst", "_end._worst_after", fall(F.col("_low"), F.col("_end._high_after"))))
    return both.withColumn(f"max_drawdown_{n}d", F.coalesce(merged, F.lit(0.0))).select(*nav.columns, f"max_drawdown_{n}d")


def portfolio_features(nav: DataFrame, holdings: DataFrame, sectors: DataFrame) -> DataFrame:
    """All portfolio features per portfolio and day."""
    series = max_drawdown(portfolio_risk(portfolio_returns(nav)))
    return (series.join(composition(holdings, sectors), ["portfolio_id", "as_of_date"], "left")
            .withColumnRenamed("as_of_date", "feature_date"))
