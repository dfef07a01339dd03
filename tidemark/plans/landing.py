"""Landing, conforming and reloading tables."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS
from tidemark.plans.registry import plain, query
from tidemark.plans.silver import cents
from tidemark.plans.sqlbase import d, using
from tidemark.sources import files, landing, ledger, loads
from tidemark.sources.scratch import scratch_path

LOADED = dt.datetime(2001, 11, 6, 4, 0)
SYSTEM = "CUSTODIAN"


def through_bronze(t, label, feed, land):
    """Exports a feed and lands it twice, of which the second must add nothing; the bronze table's rows."""
    source, table = scratch_path(t.spark, f"feed-{label}"), scratch_path(t.spark, f"bronze-{label}")
    landing.export_json(feed, source)
    for _ in range(2):
        ledger.land(t.spark, source, table, land)
    return ledger.bronze(t.spark, table)


def through_variant(t, label, feed, side=None):
    return through_bronze(t, label, feed, lambda path: landing.land_json(t.spark, path, SYSTEM, LOADED, side or {}))


def field(path, kind, name):
    return F.try_variant_get("raw_data", f"$.{path}", kind).alias(name)


STAMP = f"TIMESTAMP '{LOADED}' AS load_timestamp, '{SYSTEM}' AS source_system"


@query("bronze_prices_land", using("prices") + f"""SELECT CAST(security_id AS VARCHAR) AS security_id, trade_date AS price_date,
    floor(open_price * 100) / 100 AS open_price, floor(close_price * 100) / 100 AS close_price,
    volume, 'USD' AS currency, {STAMP}, TRUE AS has_file, CAST('{LOADED.date()}' AS DATE) AS load_date FROM prices""")
def _(t):
    feed = t.prices().select(
        F.col("security_id").cast("string"), F.col("trade_date").alias("price_date"),
        *[cents(f"{c}_price").alias(f"{c}_price") for c in ("open", "high", "low", "close")],
        cents("close_price").alias("adjusted_close"), "volume", F.lit("USD").alias("currency"))
    bronze = through_bronze(t, "prices", feed, lambda path: landing.land_prices(t.spark, path, SYSTEM, LOADED))
    return plain(bronze.select("security_id", "price_date", "open_price", "close_price", "volume", "currency", "load_timestamp",
                               "source_system", F.col("source_file").isNotNull().alias("has_file"), "load_date"))


@query("bronze_corporate_actions_land", f"""SELECT o_orderkey AS action_id, CASE o_orderstatus WHEN 'F' THEN 'DIVIDEND' WHEN 'O' THEN 'SPLIT'
    ELSE 'MERGER' END AS action, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, {STAMP} FROM orders""")
def _(t):
    feed = t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "DIVIDEND").when(F.col("o_orderstatus") == "O", "SPLIT")
        .otherwise("MERGER").alias("action"), F.struct(F.col("o_totalprice").alias("amount")).alias("terms"))
    return plain(through_variant(t, "actions", feed).select(
        field("id", "bigint", "action_id"), field("action", "string", "action"),
        field("terms.amount", "decimal(18,2)", "amount"), "load_timestamp", "source_system"))


@query("bronze_holdings_land", using("positions") + f"""SELECT CAST(portfolio_id AS VARCHAR) AS portfolio_code, as_of_date, security_id,
    CAST(quantity AS BIGINT) AS quantity, {d('market_value')}, {STAMP} FROM positions""")
def _(t):
    feed = t.positions().select(F.col("portfolio_id").cast("string").alias("account"), "as_of_date", "security_id", "quantity", "market_value")
    side = {"portfolio_code": ("$.account", "string"), "as_of_date": ("$.as_of_date", "date")}
    return plain(through_variant(t, "holdings", feed, side).select(
        "portfolio_code", "as_of_date", field("security_id", "bigint", "security_id"), field("quantity", "bigint", "quantity"),
        field("market_value", "decimal(18,4)", "market_value"), "load_timestamp", "source_system"))


@query("bronze_transactions_land", using("trades") + f"""SELECT order_id, line_no, trade_date, CAST(quantity AS BIGINT) AS quantity,
    {d('gross')}, {STAMP} FROM trades""")
def _(t):
    feed = t.trades().select("order_id", "line_no", "trade_date", "quantity", "gross")
    return plain(through_variant(t, "transactions", feed).select(
        field("order_id", "bigint", "order_id"), field("line_no", "int", "line_no"), field("trade_date", "date", "trade_date"),
        field("quantity", "bigint", "quantity"), field("gross", "decimal(12,2)", "gross"), "load_timestamp", "source_system"))


@query("bronze_securities_land", f"""SELECT p_partkey AS security_id, p_name AS name, p_brand AS ticker, p_size AS size,
    CAST(NULL AS VARCHAR) AS isin, {STAMP} FROM part""")
def _(t):
    feed = t.raw("part").select("p_partkey", "p_name", F.struct(F.col("p_brand").alias("ticker"), F.lit(None).cast("string").alias("isin")).alias("ids"), "p_size")
    return through_variant(t, "securities", feed).select(
        field("p_partkey", "bigint", "security_id"), field("p_name", "string", "name"), field("ids.ticker", "string", "ticker"),
        field("p_size", "int", "size"), field("ids.isin", "string", "isin"), "load_timestamp", "source_system")


@query("bronze_transactions_reland", using("trades") + f"""SELECT order_id, line_no, trade_date,
    CAST(quantity + CASE WHEN year(trade_date) = 1997 THEN 1 ELSE 0 END AS BIGINT) AS quantity, {d('gross')} FROM trades WHERE year(trade_date) <> 1996""")
def _(t):
    """A feed in one folder a year; then one year is delivered anew with other quantities, one is withdrawn, and all is landed again."""
    source, table = scratch_path(t.spark, "feed-years"), scratch_path(t.spark, "bronze-years")
    feed = t.trades().select("order_id", "line_no", "trade_date", "quantity", "gross", F.year("trade_date").alias("year"))

    def land():
        return ledger.land(t.spark, source, table, lambda paths: landing.land_json(t.spark, paths, SYSTEM, LOADED), mirror=True)
    landing.export_json(feed, source, "year")
    land()
    for year in (1996, 1997):
        files.remove(t.spark, f"{source}/year={year}")
    landing.export_json(feed.where("year = 1997").withColumn("quantity", F.col("quantity") + 1), source, "year")
    land()
    return plain(ledger.bronze(t.spark, table).select(
        field("order_id", "bigint", "order_id"), field("line_no", "int", "line_no"), field("trade_date", "date", "trade_date"),
        field("quantity", "bigint", "quantity"), field("gross", "decimal(12,2)", "gross")))


@query("full_reload", using("prices") + """SELECT CAST(security_id AS VARCHAR) AS security_id, CAST(year(trade_date) AS INTEGER) AS trade_year, trade_date,
    open_price AS base_price, volume FROM prices""")
def _(t):
    """A wrong first load, then a full one whose positional columns replace it year by year."""
    path = scratch_path(t.spark, "reload")
    target = ["security_id", "trade_year", "trade_date", "base_price", "volume"]
    rows = t.prices().select(F.col("security_id").cast("string").alias("a"), F.year("trade_date").alias("b"),
                             "trade_date", F.col("open_price").alias("c"), F.col("volume").alias("d"))
    loads.full_reload(rows.withColumn("d", F.lit(-1).cast("bigint")), path, target, "trade_year")
    loads.full_reload(rows, path, target, "trade_year")
    return loads.loaded(t.spark, path)


@query("schema_conform", using("nav_r") + """SELECT CAST(portfolio_id AS VARCHAR) AS portfolio_id, as_of_date,
    CAST(CAST(total_nav AS DECIMAL(18,2)) AS DOUBLE) AS total_nav, CAST(CAST(shares_outstanding AS DECIMAL(18,4)) AS DOUBLE) AS shares_outstanding,
    CAST(CAST(daily_return AS DECIMAL(10,6)) AS DOUBLE) AS daily_return, CAST(NULL AS DOUBLE) AS alpha, TRUE AS has_key, 14 AS columns FROM nav_r""")
def _(t):
    from tidemark.operators.nav import daily_return
    table = loads.conform(daily_return(t.nav()), CONTRACTS["fact_nav_history"], ["portfolio_id", "as_of_date"])
    return plain(table.select(
        "portfolio_id", "as_of_date", "total_nav", "shares_outstanding", "daily_return", "alpha",
        F.col("nav_id").isNotNull().alias("has_key"), F.lit(len(table.columns)).alias("columns")))


@query("schema_conform_defaults", using("dim_security") + """SELECT CAST(security_id AS VARCHAR) AS security_id, ticker,
    CAST(expense_ratio AS DOUBLE) AS expense_ratio, CAST(NULL AS VARCHAR) AS sedol, TRUE AS is_active, TIMESTAMP '9999-12-31 00:00:00' AS effective_to,
    TRUE AS is_current FROM dim_security""")
def _(t):
    table = loads.conform(t.dim_security(), CONTRACTS["dim_security"], ["security_id"])
    return plain(table.select("security_id", "ticker", "expense_ratio", "sedol", "is_active", "effective_to", "is_current"))
