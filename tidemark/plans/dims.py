"""Seeds, calendar, security attributes, history."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import dims, history as h
from tidemark.plans.registry import plain, query
from tidemark.plans.sqlbase import pick, using
from tidemark.sources import loads, seeds
from tidemark.sources.bindings import AS_OF_MARKET
from tidemark.sources.scratch import scratch_path


def _values(rows) -> str:
    cells = [", ".join("'" + str(v).replace("'", "''") + "'" for v in row) for row in rows]
    return "VALUES " + ", ".join(f"({i}, {c})" for i, c in enumerate(cells))


STOCKS = f"SELECT * FROM ({_values(seeds.STOCKS)}) AS s(place, company_name, ticker, sector, industry)"
FUNDS = f"SELECT * FROM ({_values(seeds.FUNDS)}) AS f(place, fund_name, ticker, category, strategy)"


def listed(t, names):
    """Every part is a series of one seed row: number = part key div list length."""
    size = {"stocks": len(seeds.STOCKS), "funds": len(seeds.FUNDS)}[names]
    rows = seeds.stock_names(t.spark) if names == "stocks" else seeds.fund_names(t.spark)
    p = F.col("p_partkey")
    return (t.raw("part").select(p, F.pmod(p, F.lit(size)).cast("int").alias("place"), F.floor(p / size).alias("number"))
            .join(rows, "place"))


STOCK_LIST = "SELECT p_partkey, p_partkey // 50 AS number, s.* FROM part JOIN stocks s ON place = p_partkey % 50"
FUND_LIST = "SELECT p_partkey, p_partkey // 40 AS number, f.* FROM part JOIN funds f ON place = p_partkey % 40"


@query("seed_values", using(stocks=STOCKS, listed=STOCK_LIST) + "SELECT p_partkey, number, company_name, ticker, sector, industry FROM listed")
def _(t):
    return listed(t, "stocks").select("p_partkey", "number", "company_name", "ticker", "sector", "industry")


@query("dim_security_keys", using(stocks=STOCKS, listed=STOCK_LIST) + """SELECT p_partkey,
    'SEC-STK-' || lpad(CAST(number AS VARCHAR), 5, '0') AS security_id,
    'US' || lpad(CAST(CAST('0x' || substr(md5(ticker || CAST(number AS VARCHAR)), 1, 8) AS BIGINT) AS VARCHAR), 10, '0') AS isin,
    lpad(CAST(CAST('0x' || substr(md5(ticker), 1, 8) AS BIGINT) AS VARCHAR), 9, '0') AS cusip,
    ticker || CASE WHEN number > 0 THEN '-' || CAST(number AS VARCHAR) ELSE '' END AS ticker,
    company_name || CASE WHEN number > 0 THEN ' Series ' || chr(CAST(65 + number % 26 AS INTEGER)) ELSE '' END AS security_name
    FROM listed""")
def _(t):
    return dims.security_keys(listed(t, "stocks"), "SEC-STK-", "number", "ticker", "company_name").select(
        "p_partkey", "security_id", "isin", "cusip", "ticker", "security_name")


@query("dim_security_classify", using(stocks=STOCKS, funds=FUNDS, s=STOCK_LIST, f=FUND_LIST) + """SELECT s.p_partkey,
    CASE WHEN sector = 'Technology' THEN 'LARGE_CAP_GROWTH' WHEN sector = 'Financials' THEN 'LARGE_CAP_VALUE'
    ELSE 'LARGE_CAP_BLEND' END AS stock_style, CASE WHEN category LIKE '%Bond%' THEN 'FIXED_INCOME'
    WHEN category LIKE '%International%' OR category LIKE '%Emerging%' THEN 'INTERNATIONAL_EQUITY' ELSE 'EQUITY' END AS fund_asset_class,
    CASE WHEN category LIKE '%Growth%' THEN 'RLG' WHEN category LIKE '%Value%' THEN 'RLV' WHEN category LIKE '%Bond%' THEN 'LBUSTRUU'
    WHEN category LIKE '%International%' THEN 'MXWO' WHEN category LIKE '%Emerging%' THEN 'MXEF' ELSE 'SPX' END AS fund_index
    FROM s JOIN f USING (p_partkey)""")
def _(t):
    p = F.col("p_partkey")
    stock = seeds.stock_names(t.spark).select("place", "sector")
    fund = seeds.fund_names(t.spark).select(F.col("place").alias("fund_place"), "category")
    both = (t.raw("part").select(p, F.pmod(p, F.lit(50)).cast("int").alias("place"), F.pmod(p, F.lit(40)).cast("int").alias("fund_place"))
            .join(stock, "place").join(fund, "fund_place"))
    return both.select("p_partkey", dims.stock_style(F.col("sector")).alias("stock_style"),
                       dims.fund_asset_class(F.col("category")).alias("fund_asset_class"),
                       dims.fund_index(F.col("category")).alias("fund_index"))


N = "p_partkey - 1000"


@query("dim_bucket_assign", f"""SELECT p_partkey, {pick(dims.EXCHANGES, N)} AS exchange, {pick(dims.STOCK_INDEXES, N)} AS benchmark_index,
    {pick(dims.RATINGS, N)} AS risk_rating, {pick(dims.FUND_MANAGERS, N)} AS fund_manager,
    CAST({pick(dims.FUND_MINIMUMS, N)} AS INTEGER) AS min_investment, {pick(dims.PORTFOLIO_TYPES, N)} AS portfolio_type,
    {pick(dims.STRATEGIES, N)} AS strategy, CAST({pick(dims.PORTFOLIO_MINIMUMS, N)} AS INTEGER) AS portfolio_minimum FROM part""")
def _(t):
    numbered = t.raw("part").select("p_partkey", (F.col("p_partkey") - 1000).alias("n"))
    return dims.assign_buckets(numbered, "n").drop("n")


START, DAYS = dt.date(1995, 1, 1), 2557
CALENDAR = f"""SELECT CAST(strftime(c, '%Y%m%d') AS BIGINT) AS date_key, c AS calendar_date, year(c) AS year, quarter(c) AS quarter,
    month(c) AS month, strftime(c, '%b') AS month_name, weekofyear(c) AS week_of_year, dayofweek(c) AS day_of_week,
    strftime(c, '%a') AS day_name, dayofweek(c) IN (0, 6) AS is_weekend, dayofweek(c) NOT IN (0, 6) AS is_us_trading_day,
    c = last_day(c) AS is_month_end, month(c) IN (3, 6, 9, 12) AND c = last_day(c) AS is_quarter_end,
    month(c) = 12 AND day(c) = 31 AS is_year_end, year(c) AS fiscal_year, quarter(c) AS fiscal_quarter
    FROM (SELECT CAST(DATE '{START}' + CAST(i AS INTEGER) AS DATE) AS c FROM range({DAYS}) t(i)) WHERE c <= DATE '{AS_OF_MARKET}'"""


def calendar(t):
    return dims.dim_date(t.spark, START, DAYS, AS_OF_MARKET)


@query("dim_date", using("trades", cal=CALENDAR) + """SELECT cal.*, count(trade_date) AS trades FROM cal
    LEFT JOIN trades ON trade_date = calendar_date GROUP BY ALL""")
def _(t):
    per_day = t.trades().groupBy(F.col("trade_date").alias("calendar_date")).agg(F.count("*").alias("trades"))
    return calendar(t).join(per_day, "calendar_date", "left").na.fill(0, ["trades"])


@query("dim_date_trading_days", using("trades", cal=CALENDAR) + f"""SELECT portfolio_id, trade_date, count(*) AS trades FROM trades
    WHERE trade_date IN (SELECT calendar_date FROM cal WHERE is_us_trading_day
    AND calendar_date BETWEEN DATE '{AS_OF_MARKET}' - INTERVAL 6 MONTH AND DATE '{AS_OF_MARKET}') GROUP BY 1, 2""")
def _(t):
    days = dims.trading_days(calendar(t), AS_OF_MARKET, months=6).withColumnRenamed("calendar_date", "trade_date")
    return t.trades().join(days, "trade_date", "left_semi").groupBy("portfolio_id", "trade_date").agg(F.count("*").alias("trades"))


# --- history --------------------------------------------------------------------------------------

VERSIONS = dict(
    daily="""SELECT o_custkey AS key, o_orderdate AS effective_from, last(o_orderpriority ORDER BY o_orderkey) AS attribute
        FROM orders GROUP BY 1, 2""",
    moved="""SELECT * FROM (SELECT *, lag(attribute) OVER (PARTITION BY key ORDER BY effective_from) AS before FROM daily)
        WHERE before IS DISTINCT FROM attribute""",
    ver="""SELECT key, attribute, effective_from, coalesce(lead(effective_from) OVER w, TIMESTAMP '9999-12-31 00:00:00') AS effective_to,
        lead(effective_from) OVER w IS NULL AS is_current FROM moved WINDOW w AS (PARTITION BY key ORDER BY effective_from)""")
CUT = "1999-06-15"
ARGS = ("key", ["attribute"], "changed_at", "change_id")


@query("scd2_build", using(**VERSIONS) + "SELECT * FROM ver")
def _(t):
    return h.scd2_build(t.attribute_changes(), *ARGS)


@query("scd2_merge", using(**VERSIONS) + "SELECT * FROM ver")
def _(t):
    """A dimension built from the early changes, then merged on disk with the later ones."""
    changes, path = t.attribute_changes(), scratch_path(t.spark, "dim")
    early = F.col("changed_at") < F.lit(CUT).cast("timestamp_ntz")
    h.write_dimension(h.scd2_build(changes.where(early), *ARGS), path, "key", 8)
    h.merge_into_dimension(t.spark, path, changes.where(~early), *ARGS, buckets=8)
    return h.read_dimension(t.spark, path)


@query("scd2_current", using(**VERSIONS) + "SELECT key, attribute, effective_from FROM ver WHERE is_current")
def _(t):
    return h.current(h.scd2_build(t.attribute_changes(), *ARGS)).select("key", "attribute", "effective_from")


@query("scd2_point_in_time", using(**VERSIONS) + """SELECT o_orderkey, o_custkey AS key, fact_date, attribute, effective_from FROM (SELECT *,
    o_orderdate + to_days(CAST(o_orderkey % 90 - 20 AS INTEGER)) AS fact_date FROM orders) f
    JOIN ver ON key = o_custkey AND fact_date >= effective_from AND fact_date < effective_to""")
def _(t):
    facts = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.timestamp_add(
        "DAY", F.col("o_orderkey") % 90 - 20, "o_orderdate").cast("timestamp_ntz").alias("fact_date"))
    versions = h.scd2_build(t.attribute_changes(), *ARGS)
    return h.point_in_time(facts, versions, "key", "fact_date", AS_OF_MARKET).drop("effective_to", "is_current")


@query("history_snapshot", """SELECT o_orderstatus, count(*) AS orders, CAST(max(o_orderkey) AS BIGINT) AS last_order,
    DATE '1998-12-31' AS snapshot_date FROM orders WHERE o_orderdate < TIMESTAMP '1998-12-31' GROUP BY 1""")
def _(t):
    path, orders = scratch_path(t.spark, "snapshots"), t.raw("orders")
    for taken in ("1997-12-31", "1998-12-31", "1999-12-31"):
        state = orders.where(F.col("o_orderdate") < F.lit(taken).cast("timestamp_ntz")).groupBy("o_orderstatus").agg(
            F.count("*").alias("orders"), F.max("o_orderkey").alias("last_order"))
        loads.write_snapshot(state, path, taken)
    return loads.read_snapshot(t.spark, path, "1999-06-30")
