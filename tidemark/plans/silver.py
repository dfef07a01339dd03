"""Cleaning, derived columns and NAV returns."""

from pyspark.sql import functions as F

from tidemark.operators import nav as n, silver as s
from tidemark.plans.registry import plain, query
from tidemark.plans.sqlbase import NAV_W, d, r, using
from tidemark.sources.bindings import AS_OF_MARKET



def cents(column: str):
    """Prices cut to whole cents, as vendors quote them."""
    return (F.floor(F.col(column) * 100) / 100).cast("decimal(18,2)")


@query("silver_parse_variant", using("prices") + """SELECT 'S' || CAST(security_id AS VARCHAR) AS ticker, trade_date,
    CASE WHEN security_id % 50 <> 0 THEN floor(open_price * 100) / 100 END AS open_price,
    floor(high_price * 100) / 100 AS high_price,
    CASE WHEN security_id % 30 <> 0 THEN floor(low_price * 100) / 100 END AS low_price,
    floor(close_price * 100) / 100 AS close_price, volume FROM prices""")
def _(t):
    vendor = t.prices().select(F.struct(
        F.concat(F.lit("S"), F.col("security_id").cast("string")).alias("ticker"),
        F.col("trade_date").cast("string").alias("date"),
        # a text where a number belongs, and a field that is absent
        F.when(F.col("security_id") % 50 == 0, "n/a").otherwise(cents("open_price").cast("string")).alias("px_open"),
        cents("high_price").alias("px_high"),
        F.when(F.col("security_id") % 30 != 0, cents("low_price")).alias("px_low"),
        cents("close_price").alias("px_last"), "volume").alias("doc"))
    landed = vendor.select(F.try_parse_json(F.to_json("doc")).alias("raw_data"))
    return plain(s.parse_variant(landed))


@query("silver_type_standardise", """SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS order_date,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS total,
    CASE WHEN o_orderkey % 13 = 0 THEN 'UNKNOWN' ELSE o_orderpriority END AS priority, coalesce(NULL, 'USD') AS currency FROM orders""")
def _(t):
    key = F.col("o_orderkey")
    messy = t.raw("orders").select(
        key, F.when(key % 17 == 0, "soon").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("order_date"),
        F.when(key % 19 == 0, "12x").otherwise(F.format_number("o_totalprice", 2)).alias("total"),
        F.when(key % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" "))).alias("priority"),
        F.lit(None).cast("string").alias("currency"))
    return plain(s.standardise(messy, dates={"order_date": "dd/MM/yyyy"}, numbers={"total": "decimal(18,2)"},
                               codes=["priority"], defaults={"priority": "UNKNOWN", "currency": "USD"}))


LATEST = ["trade_date", "security_id", "portfolio_id", "gross", "quantity", "net", "fee_rate", "flag"]


@query("silver_dedupe", using("trades") + f"""SELECT order_id, line_no, trade_date, security_id, portfolio_id, quantity, {d('gross')}
    FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_no ORDER BY {', '.join(c + ' DESC' for c in LATEST)}) AS rn
    FROM trades) WHERE rn = 1""")
def _(t):
    return plain(s.dedupe_latest(t.trades(), ["order_id", "line_no"], LATEST).select(
        "order_id", "line_no", "trade_date", "security_id", "portfolio_id", "quantity", "gross"))


PRIORITY = ["isin", "cusip", "sedol", "ticker"]
IDS_SQL = dict(
    dim="""SELECT p_partkey AS security_id, 'US' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isin,
        lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS cusip, 'S' || CAST(p_partkey % 500 AS VARCHAR) AS sedol, p_brand AS ticker FROM part""",
    rec="""SELECT o_orderkey AS record_id,
        CASE WHEN o_orderkey % 20 = 0 THEN 'XX0' WHEN o_orderkey % 4 = 0 THEN 'US' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS isin,
        CASE WHEN o_orderkey % 4 IN (0, 1) THEN lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS cusip,
        CASE WHEN o_orderkey % 4 = 2 THEN 'S' || CAST(o_custkey % 600 AS VARCHAR) END AS sedol,
        CASE WHEN o_orderkey % 8 <> 7 THEN 'Brand#' || CAST(o_custkey % 30 AS VARCHAR) END AS ticker FROM orders""")
_MAPS = " ".join(f"LEFT JOIN (SELECT {c}, min(security_id) AS s FROM dim GROUP BY 1) m{i} ON m{i}.{c} = rec.{c}"
                 for i, c in enumerate(PRIORITY))


@query("silver_identifier_map", using(**IDS_SQL) + f"""SELECT record_id, coalesce(m0.s, m1.s, m2.s, m3.s) AS security_id,
    CASE WHEN m0.s IS NOT NULL THEN 'isin' WHEN m1.s IS NOT NULL THEN 'cusip' WHEN m2.s IS NOT NULL THEN 'sedol'
    WHEN m3.s IS NOT NULL THEN 'ticker' END AS matched_on FROM rec {_MAPS}""")
def _(t):
    p, o, c = F.col("p_partkey"), F.col("o_orderkey"), F.col("o_custkey")
    dim = t.raw("part").select(
        p.alias("security_id"), F.concat(F.lit("US"), F.lpad(p.cast("string"), 10, "0")).alias("isin"),
        F.lpad(p.cast("string"), 9, "0").alias("cusip"), F.concat(F.lit("S"), (p % 500).cast("string")).alias("sedol"),
        F.col("p_brand").alias("ticker"))
    records = t.raw("orders").select(
        o.alias("record_id"),
        F.when(o % 20 == 0, "XX0").when(o % 4 == 0, F.concat(F.lit("US"), F.lpad(c.cast("string"), 10, "0"))).alias("isin"),
        F.when((o % 4).isin(0, 1), F.lpad(c.cast("string"), 9, "0")).alias("cusip"),
        F.when(o % 4 == 2, F.concat(F.lit("S"), (c % 600).cast("string"))).alias("sedol"),
        F.when(o % 8 != 7, F.concat(F.lit("Brand#"), (c % 30).cast("string"))).alias("ticker"))
    return s.map_identifiers(records, dim, "record_id", PRIORITY).select("record_id", "security_id", "matched_on")


@query("silver_currency_convert", using("trades", fact="""SELECT order_id, line_no, security_id, trade_date, net,
      'C' || CAST(portfolio_id % 25 AS VARCHAR) AS currency FROM trades""",
    rates="""SELECT 'C' || CAST(o_custkey % 25 AS VARCHAR) AS currency, CAST(o_orderdate AS DATE) AS rate_date,
      CAST(0.5 + (max(o_orderkey) % 100) * 0.01 AS DECIMAL(10,2)) AS rate FROM orders GROUP BY 1, 2""")
    + f"""SELECT order_id, line_no, security_id, trade_date, fact.currency, {d('rate')},
    CAST(net AS DOUBLE) * CAST(rate AS DOUBLE) AS net_base FROM fact ASOF LEFT JOIN rates
    ON fact.currency = rates.currency AND fact.trade_date >= rates.rate_date""")
def _(t):
    facts = t.trades().select("order_id", "line_no", "security_id", "trade_date", "net",
                              F.concat(F.lit("C"), (F.col("portfolio_id") % 25).cast("string")).alias("currency"))
    rates = t.raw("orders").groupBy(
        F.concat(F.lit("C"), (F.col("o_custkey") % 25).cast("string")).alias("currency"),
        F.col("o_orderdate").cast("date").alias("rate_date")).agg(
        (F.lit(0.5).cast("decimal(2,1)") + (F.max("o_orderkey") % 100).cast("decimal(4,0)") / 100).cast("decimal(10,2)").alias("rate"))
    return plain(s.convert_currency(facts, rates, "net", F.lit(str(AS_OF_MARKET)).cast("date")).drop("net"))


@query("silver_rule_validate", using("prices", p="""SELECT CASE WHEN security_id % 40 <> 1 THEN security_id END AS security_id, trade_date,
      CASE WHEN security_id % 7 = 0 THEN low_price - 1 ELSE high_price END AS high_price, low_price,
      CASE WHEN security_id % 11 = 0 THEN -close_price ELSE close_price END AS close_price,
      CASE WHEN security_id % 13 = 0 THEN 'EURO' WHEN security_id % 17 <> 0 THEN 'USD' END AS currency FROM prices""")
    + """, f AS (SELECT *, concat_ws(',', CASE WHEN security_id IS NULL THEN 'security_id_present' END,
      CASE WHEN NOT high_price >= low_price THEN 'high_not_below_low' END, CASE WHEN NOT close_price > 0 THEN 'close_positive' END,
      CASE WHEN NOT coalesce(length(currency) <= 3, FALSE) THEN 'currency_is_iso' END) AS failed_rules FROM p)
    SELECT security_id, trade_date, close_price, failed_rules, CASE WHEN failed_rules = '' THEN 'CERTIFIED' ELSE 'QUARANTINED' END
    AS dq_status FROM f""")
def _(t):
    k = F.col("security_id")
    dirty = t.prices().select(
        F.when(k % 40 != 1, k).alias("security_id"), "trade_date",
        F.when(k % 7 == 0, F.col("low_price") - 1).otherwise(F.col("high_price")).alias("high_price"), "low_price",
        F.when(k % 11 == 0, -F.col("close_price")).otherwise(F.col("close_price")).alias("close_price"),
        F.when(k % 13 == 0, "EURO").when(k % 17 != 0, "USD").alias("currency"))
    checked = s.validate(dirty, s.price_rules())
    return checked.select("security_id", "trade_date", "close_price", F.array_join("failed_rules", ",").alias("failed_rules"), "dq_status")


@query("silver_daily_prices", using("prices") + "SELECT * FROM prices")
def _(t):
    return t.prices()


@query("silver_daily_prices_by_brand", using("brand_prices") + "SELECT * FROM brand_prices")
def _(t):
    return t.brand_prices()


@query("silver_holdings_metrics", using("held") + f"""SELECT security_id, portfolio_id, as_of_date, {d('market_value')}, {d('cost_basis')},
    {d('unrealized_pnl')}, gain_loss_pct, annualized_return, holding_period_days FROM held""")
def _(t):
    return plain(s.holdings_metrics(t.holdings()).select(
        "security_id", "portfolio_id", "as_of_date", "market_value", "cost_basis", "unrealized_pnl", "gain_loss_pct",
        "annualized_return", "holding_period_days"))


@query("silver_weight_pct", using("weighed") + f"""SELECT security_id, portfolio_id, as_of_date, {d('market_value')}, weight_pct FROM weighed""")
def _(t):
    return plain(s.weight_pct(t.positions()).select("security_id", "portfolio_id", "as_of_date", "market_value", "weight_pct"))


@query("silver_benchmark_compare", using("positions") + f"""SELECT security_id, portfolio_id, as_of_date, {d('benchmark_value')},
    {d('market_value - benchmark_value', 'vs_benchmark')} FROM positions""")
def _(t):
    return plain(s.benchmark_compare(t.positions()).select(
        "security_id", "portfolio_id", "as_of_date", "benchmark_value", "vs_benchmark"))


NET = """CASE transaction_type WHEN 'BUY' THEN gross_amount + (commission + fees) WHEN 'SELL' THEN gross_amount - (commission + fees) END"""


@query("silver_transactions", using("transactions") + f"""SELECT portfolio_id, transaction_type, count(*) AS trades,
    CAST(sum(quantity) AS BIGINT) AS quantity, {d('sum(gross_amount)', 'gross_amount')}, {d(f'sum({NET})', 'net_amount')}
    FROM transactions GROUP BY 1, 2""")
def _(t):
    return plain(s.transaction_totals(t.transactions()))


@query("silver_transaction_amounts", using("transactions") + f"""SELECT order_id, line_no, trade_date, portfolio_id, security_id,
    transaction_type, {d('gross_amount')}, {d('commission')}, {d('fees')}, {d(NET, 'net_amount')} FROM transactions""")
def _(t):
    return plain(s.transaction_amounts(t.transactions()).drop("price", "quantity"))


@query("silver_nav_daily_return", using("nav_r") + "SELECT portfolio_id, as_of_date, nav_per_share, daily_return FROM nav_r")
def _(t):
    return n.daily_return(t.nav()).select("portfolio_id", "as_of_date", "nav_per_share", "daily_return")


@query("silver_nav_period_returns", using("nav_history") + """SELECT portfolio_id, as_of_date, nav_per_share, mtd_return, qtd_return,
    ytd_return FROM nav_history""")
def _(t):
    return n.period_returns(t.nav()).select("portfolio_id", "as_of_date", "nav_per_share", "mtd_return", "qtd_return", "ytd_return")


BETA = "covar_samp(daily_return, benchmark_return) / var_samp(benchmark_return)"


@query("silver_nav_alpha_beta", using("nav_r") + f"""SELECT portfolio_id, count(*) AS days, {r(BETA, 3, 'beta')},
    {r(f'avg(daily_return) - {BETA} * avg(benchmark_return)', 3, 'alpha')} FROM nav_r
    WHERE daily_return IS NOT NULL AND benchmark_return IS NOT NULL GROUP BY portfolio_id""")
def _(t):
    return plain(n.alpha_beta(n.benchmark_return(n.daily_return(t.benchmarked_nav()))), beta=3, alpha=3)


@query("silver_nav_alpha_beta_60", using("nav_history") + f"""SELECT portfolio_id, as_of_date, {r('beta', 3, 'beta')}, {r('alpha', 3, 'alpha')}
    FROM nav_history""")
def _(t):
    return plain(t.nav_history().select("portfolio_id", "as_of_date", "beta", "alpha"), beta=3, alpha=3)


@query("silver_currency_convert_intraday", """WITH fact AS (SELECT event_id, 'C' || CAST(user_id % 7 AS VARCHAR) AS currency, ts, CAST(value AS DECIMAL(12,2)) AS amount
      FROM events WHERE event_type <> 'view'),
    rates AS (SELECT 'C' || CAST(event_id % 7 AS VARCHAR) AS currency, ts, CAST(max(50 + user_id % 100) AS DECIMAL(10,2)) / 100 AS rate
      FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT event_id, fact.currency, fact.ts, CAST(rate AS DOUBLE) AS rate, CAST(amount AS DOUBLE) * CAST(rate AS DOUBLE) AS amount_base
    FROM fact ASOF LEFT JOIN rates ON fact.currency = rates.currency AND fact.ts >= rates.ts""")
def _(t):
    """Rates that change within the day: every view of the log quotes one, all other events are converted."""
    events = t.raw("events")
    viewed = F.col("event_type") == "view"
    code = lambda column: F.concat(F.lit("C"), (F.col(column) % 7).cast("string")).alias("currency")
    facts = events.where(~viewed).select("event_id", code("user_id"), "ts", F.col("value").cast("decimal(12,2)").alias("amount"))
    rates = events.where(viewed).select(code("event_id"), "ts", ((50 + F.col("user_id") % 100).cast("decimal(10,2)") / 100).cast("decimal(10,2)").alias("rate"))
    return plain(s.convert_currency_at(facts, rates, "amount", "ts").drop("amount"))
