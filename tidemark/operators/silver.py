"""Bronze to silver: parse, standardise, dedupe, resolve, convert, validate, derive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.measures import annualised, dbl, gain_loss_pct, ratio
from tidemark.operators.asof import last_known

# fixed values: vendor field name, silver name, silver type
PRICE_FIELDS = [
    ("ticker", "ticker", "string"), ("date", "trade_date", "date"),
    ("px_open", "open_price", "decimal(18,6)"), ("px_high", "high_price", "decimal(18,6)"),
    ("px_low", "low_price", "decimal(18,6)"), ("px_last", "close_price", "decimal(18,6)"),
    ("volume", "volume", "bigint"),
]


def parse_variant(landed: DataFrame, fields: Sequence[tuple[str, str, str]] = PRICE_FIELDS,
                  source: str = "raw_data") -> DataFrame:
    """Typed columns from a VARIANT column; a value of the wrong type becomes NULL."""
    typed = {out: F.try_variant_get(source, f"$.{key}", kind) for key, out, kind in fields}
    return landed.withColumns(typed).drop(source)


def standardise(df: DataFrame, dates: Mapping[str, str] = {}, numbers: Mapping[str, str] = {},
                codes: Sequence[str] = (), defaults: Mapping[str, object] = {}) -> DataFrame:
    """Dates by pattern, numbers by type, codes trimmed and upper-cased, then NULL defaults."""
    out: dict[str, Column] = {}
    for name, pattern in dates.items():
        out[name] = F.try_to_date(F.trim(name), pattern)
    for name, kind in numbers.items():
        out[name] = F.regexp_replace(F.trim(name), ",", "").try_cast(kind)
    for name in codes:
        out[name] = F.nullif(F.upper(F.trim(name)), F.lit(""))
    for name, value in defaults.items():
        out[name] = F.coalesce(out.get(name, F.col(name)), F.lit(value))
    return df.withColumns(out)


def dedupe_latest(df: DataFrame, key: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """One row per key, the greatest in ``latest``.

    ``row_number() = 1`` lets Spark keep one row per key in every map task before the shuffle,
    so a key with very many copies does not land in one reducer.
    """
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in latest])
    return df.withColumn("_copy", F.row_number().over(newest)).where("_copy = 1").drop("_copy")


def identifier_index(dim: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(id_type, id_value) -> security_id; an identifier shared by several securities gives the smallest id."""
    typed = ", ".join(f"'{c}', cast({c} as string)" for c in priority)
    return (dim.selectExpr("security_id", f"stack({len(priority)}, {typed}) as (id_type, id_value)")
            .where("id_value IS NOT NULL").groupBy("id_type", "id_value").agg(F.min("security_id").alias("security_id")))


def map_identifiers(records: DataFrame, dim: DataFrame, record_key: str, priority: Sequence[str]) -> DataFrame:
    """Resolve each record to the security of its first identifier, in priority order, that is known.

    One equi-join serves all identifier types; records with none known keep a NULL security.
    """
    typed = ", ".join(f"{i}, '{c}', cast({c} as string)" for i, c in enumerate(priority))
    asked = records.selectExpr(record_key, f"stack({len(priority)}, {typed}) as (rank, id_type, id_value)")
    found = asked.where("id_value IS NOT NULL").join(identifier_index(dim, priority), ["id_type", "id_value"])
    best = found.groupBy(record_key).agg(F.min_by("security_id", "rank").alias("security_id"),
                                         F.min_by("id_type", "rank").alias("matched_on"))
    return records.join(best, record_key, "left")


def dense_rates(rates: DataFrame, horizon: Column) -> DataFrame:
    """Rates (currency, rate_date, rate) carried forward to every day until the next rate.

    At most currencies x days rows, whatever the facts, so facts need only an equi-join.
    """
    per_currency = Window.partitionBy("currency").orderBy("rate_date")
    until = F.coalesce(F.date_sub(F.lead("rate_date").over(per_currency), 1), F.greatest("rate_date", horizon))
    return (rates.withColumn("until", until)
            .select("currency", "rate", F.explode(F.sequence("rate_date", "until")).alias("rate_date")))


def convert_currency(facts: DataFrame, rates: DataFrame, amount: str, horizon: Column,
                     date: str = "trade_date") -> DataFrame:
    """``amount`` in base currency at the latest rate on or before the date; NULL before the first rate."""
    daily = dense_rates(rates, horizon).withColumnRenamed("rate_date", date)
    return (facts.join(daily, ["currency", date], "left")
            .withColumn(f"{amount}_base", dbl(amount) * dbl("rate")))


def convert_currency_at(facts: DataFrame, rates: DataFrame, amount: str, at: str) -> DataFrame:
    """``amount`` in base currency at the latest rate at or before the instant ``at`` of both sides; NULL before the first rate.

    Rates may change at any moment; a hot currency is dealt out by day.
    """
    return last_known(facts, rates, ["currency"], at, ["rate"]).withColumn(f"{amount}_base", dbl(amount) * dbl("rate"))


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``failed_rules`` (names of broken rules; unknown counts as broken) and ``dq_status``."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return (df.withColumn("failed_rules", broken)
            .withColumn("dq_status", F.when(F.size("failed_rules") == 0, "CERTIFIED").otherwise("QUARANTINED")))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with reasons) of :func:`validate`."""
    good = checked.where("dq_status = 'CERTIFIED'").drop("failed_rules")
    return good, checked.where("dq_status = 'QUARANTINED'")


def price_rules() -> dict[str, Column]:
    return {
        "security_id_present": F.col("security_id").isNotNull(),
        "trade_date_present": F.col("trade_date").isNotNull(),
        "high_not_below_low": F.col("high_price") >= F.col("low_price"),
        "close_positive": F.col("close_price") > 0,
        "currency_is_iso": F.length("currency") <= 3,
    }


def daily_prices(trades: DataFrame, tie: Sequence[str]) -> DataFrame:
    """OHLC, volume and volume-weighted price per security and day, trades ordered by ``tie``."""
    order = F.struct(*tie, "price")
    return trades.groupBy("security_id", "trade_date").agg(
        F.min_by("price", order).alias("open_price"), F.max("price").alias("high_price"),
        F.min("price").alias("low_price"), F.max_by("price", order).alias("close_price"),
        F.sum("quantity").alias("volume"), ratio(F.sum("gross"), F.sum("quantity")).alias("vwap"))


def holdings_metrics(holdings: DataFrame, *, pct_on_market_value: bool = False) -> DataFrame:
    mv, cost = F.col("market_value"), F.col("cost_basis")
    of_cost = gain_loss_pct(mv, cost)
    return holdings.withColumns({
        "unrealized_pnl": mv - cost,
        "gain_loss_pct": gain_loss_pct(mv, cost, on_market_value=pct_on_market_value),
        "annualized_return": annualised(of_cost, "holding_period_days"),
    })


def weight_pct(holdings: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Share of the portfolio's value that day, or of the value of the holdings ``of`` where those are others.

    Totals are a separate aggregate (summed before the shuffle) rather than a window, so a very
    large portfolio-day is never sorted in one task; the join back is split by AQE when skewed.
    """
    totals = (holdings if of is None else of).groupBy("portfolio_id", "as_of_date").agg(F.sum("market_value").alias("_total"))
    # a left join on unique keys is dropped by Catalyst wherever the weight is not used
    return (holdings.join(totals, ["portfolio_id", "as_of_date"], "left")
            .withColumn("weight_pct", ratio("market_value", "_total")).drop("_total"))


def benchmark_compare(holdings: DataFrame) -> DataFrame:
    return holdings.withColumn("vs_benchmark", F.col("market_value") - F.col("benchmark_value"))


def transaction_amounts(tx: DataFrame) -> DataFrame:
    """Buys cost gross plus charges; sells bring gross minus charges."""
    charges = F.col("commission") + F.col("fees")
    signed = F.when(F.col("transaction_type") == "BUY", F.col("gross_amount") + charges) \
              .when(F.col("transaction_type") == "SELL", F.col("gross_amount") - charges) \
              .otherwise(F.col("gross_amount"))
    return tx.withColumnRenamed("gross", "gross_amount").withColumn("net_amount", signed)


def transaction_totals(tx: DataFrame) -> DataFrame:
    return transaction_amounts(tx).groupBy("portfolio_id", "transaction_type").agg(
        F.count("*").alias("trades"), F.sum("quantity").alias("quantity"),
        F.sum("gross_amount").alias("gross_amount"), F.sum("net_amount").alias("net_amount"))
