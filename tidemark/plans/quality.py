"""Validation reports."""

from pyspark.sql import functions as F

from tidemark.operators import quality as q, silver
from tidemark.plans.gold import SUMMARY, SUMMARY_INPUTS, summary
from tidemark.plans.registry import ORACLES, plain, query
from tidemark.plans.sqlbase import d, r, using
from tidemark.sources.bindings import AS_OF_LOG, AS_OF_MARKET, Tables

# fixed values: record targets of the validation script
TARGETS = {"DIM_SECURITY": 500, "DIM_PORTFOLIO": 50, "DIM_DATE": 1000, "FACT_HOLDINGS": 5000,
           "FACT_DAILY_PRICES": 3000, "FACT_NAV_HISTORY": 2000}


def metrics(t: Tables):
    return silver.holdings_metrics(t.holdings())


def counted(t: Tables):
    trades = t.trades()
    return q.table_counts({
        "DIM_SECURITY": t.raw("part"), "DIM_PORTFOLIO": t.dim_portfolio(),
        "DIM_DATE": trades.select("trade_date").distinct(),
        "FACT_HOLDINGS": trades.select("trade_date", "portfolio_id", "security_id").distinct(),
        "FACT_DAILY_PRICES": trades.select("trade_date", "security_id").distinct(),
        "FACT_NAV_HISTORY": trades.select("trade_date", "portfolio_id").distinct()})


COUNTS = """SELECT 'DIM_SECURITY' AS table_name, count(*) AS record_count FROM part
    UNION ALL SELECT 'DIM_PORTFOLIO', count(*) FROM dim_portfolio
    UNION ALL SELECT 'DIM_DATE', count(DISTINCT trade_date) FROM trades
    UNION ALL SELECT 'FACT_HOLDINGS', count(*) FROM lots
    UNION ALL SELECT 'FACT_DAILY_PRICES', count(*) FROM prices
    UNION ALL SELECT 'FACT_NAV_HISTORY', count(*) FROM nav_day"""
COUNT_INPUTS = ("dim_portfolio", "lots", "prices", "nav_day")


@query("table_row_counts", using(*COUNT_INPUTS) + COUNTS)
def _(t):
    return counted(t)


@query("dq_total_records", using(*COUNT_INPUTS, c=COUNTS) + """SELECT CAST(sum(record_count) AS BIGINT) AS total_records,
    CASE WHEN sum(record_count) >= 10000 THEN 'PASS' WHEN sum(record_count) >= 8000 THEN 'WARNING' ELSE 'FAIL' END
    AS validation_result FROM c""")
def _(t):
    return q.total_records(counted(t))


@query("dq_count_targets", using(*COUNT_INPUTS, c=COUNTS) + "SELECT *, CASE "
       + " ".join(f"WHEN table_name = '{k}' AND record_count >= {v} THEN 'TARGET MET'" for k, v in TARGETS.items())
       + " ELSE 'BELOW TARGET' END AS target_check FROM c")
def _(t):
    return q.count_targets(counted(t), TARGETS)


@query("dq_securities_by_type", using("dim_security") + """SELECT security_type, count(*) AS count,
    CAST(ROUND(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS DOUBLE) AS percentage
    FROM dim_security WHERE is_current GROUP BY security_type""")
def _(t):
    return plain(q.share_by(t.dim_security().where("is_current"), "security_type"))


@query("dq_holdings_nulls", using("positions") + """SELECT count(*) AS total_holdings,
    count(CASE WHEN cost_basis IS NULL THEN 1 END) AS null_cost_basis,
    count(CASE WHEN market_value IS NULL THEN 1 END) AS null_market_value,
    count(CASE WHEN cost_basis <= 0 THEN 1 END) AS invalid_cost_basis,
    count(CASE WHEN market_value <= 0 THEN 1 END) AS invalid_market_value,
    CASE WHEN count(CASE WHEN cost_basis IS NULL OR market_value IS NULL THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END
    AS quality_check FROM positions""")
def _(t):
    return q.holdings_nulls(t.positions())


@query("dq_gain_loss_check", using("held") + """SELECT count(*) AS total_records,
    count(CASE WHEN abs(unrealized_pnl - (market_value - cost_basis)) > 0.01 THEN 1 END) AS calculation_errors,
    CASE WHEN count(CASE WHEN abs(unrealized_pnl - (market_value - cost_basis)) > 0.01 THEN 1 END) = 0
    THEN 'PASS' ELSE 'WARNING' END AS validation_result FROM held WHERE cost_basis IS NOT NULL AND market_value IS NOT NULL""")
def _(t):
    return q.gain_loss_check(metrics(t))


def _orphan_sql(dim: str, key: str) -> str:
    return using("lots", dim) + f"""SELECT count(*) AS orphan_holdings, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END
        AS validation_result FROM lots h LEFT JOIN {dim} s USING ({key})
        WHERE s.{key} IS NULL"""


def _lots(t):
    return t.trades().select("trade_date", "portfolio_id", "security_id").distinct()


@query("dq_orphan_securities", _orphan_sql("dim_security", "security_id"))
def _(t):
    return q.orphans(_lots(t), t.dim_security().where("is_current"), "security_id")


@query("dq_orphan_portfolios", _orphan_sql("dim_portfolio", "portfolio_id"))
def _(t):
    return q.orphans(_lots(t), t.dim_portfolio(), "portfolio_id")


@query("dq_date_range", using("lots") + f"""SELECT min(trade_date) AS earliest_date, max(trade_date) AS latest_date,
    count(DISTINCT trade_date) AS unique_dates, CASE WHEN max(trade_date) <= DATE '{AS_OF_MARKET}' THEN 'PASS' ELSE 'FAIL' END
    AS date_check FROM lots""")
def _(t):
    return q.date_range(t.trades().withColumnRenamed("trade_date", "as_of_date"), AS_OF_MARKET)


@query("dq_value_summary", using("held") + f"""SELECT count(*) AS total_positions,
    {d('ROUND(sum(cost_basis), 2)', 'total_cost_basis')}, {d('ROUND(sum(market_value), 2)', 'total_market_value')},
    {d('ROUND(sum(unrealized_pnl), 2)', 'total_unrealized_pnl')}, {r('avg(gain_loss_pct)', 4, 'avg_return_pct')},
    count(CASE WHEN unrealized_pnl > 0 THEN 1 END) AS profitable_positions,
    count(CASE WHEN unrealized_pnl < 0 THEN 1 END) AS losing_positions FROM held""")
def _(t):
    return plain(q.value_summary(metrics(t)))


@query("dq_nav_quality", using("nav_history") + """SELECT count(*) AS total_records,
    count(CASE WHEN nav_per_share IS NULL THEN 1 END) AS null_nav,
    count(CASE WHEN daily_return IS NULL THEN 1 END) AS null_daily_return, count(alpha) AS with_alpha,
    count(beta) AS with_beta, min(as_of_date) AS earliest_nav, max(as_of_date) AS latest_nav FROM nav_history""")
def _(t):
    return q.nav_quality(t.nav_history())


@query("dq_security_distribution", using("dim_security") + f"""SELECT security_type, count(*) AS count,
    count(DISTINCT ticker) AS unique_tickers, count(DISTINCT sector) AS sectors,
    count(DISTINCT benchmark_index) AS benchmarks,
    CAST(ROUND(CAST(sum(expense_ratio) AS DECIMAL(18,4)) / count(*), 4) AS DOUBLE) AS avg_expense_ratio
    FROM dim_security WHERE is_current GROUP BY security_type""")
def _(t):
    return plain(q.security_distribution(t.dim_security()))


@query("dq_portfolio_distribution", using("dim_portfolio") + f"""SELECT portfolio_type, strategy, count(*) AS count,
    {r('avg(management_fee)', 6, 'avg_mgmt_fee')}, {r('avg(expense_ratio)', 6, 'avg_expense')}
    FROM dim_portfolio GROUP BY 1, 2""")
def _(t):
    return plain(q.portfolio_distribution(t.dim_portfolio()), avg_mgmt_fee=6, avg_expense=6)


COMPLETE = {"pct_has_cost_basis": "cost_basis", "pct_has_market_value": "market_value", "pct_has_pnl": "unrealized_pnl",
            "pct_has_benchmark": "benchmark_value", "pct_has_return": "gain_loss_pct",
            "pct_has_ann_return": "annualized_return"}


@query("dq_completeness", using("held") + "SELECT count(*) AS total_holdings, "
       + ", ".join(f"CAST(ROUND(count({c}) * 100.0 / count(*), 2) AS DOUBLE) AS {o}" for o, c in COMPLETE.items()) + " FROM held")
def _(t):
    return plain(q.completeness(metrics(t), COMPLETE))


def flat(reports):
    """One column for each measure, named after its report."""
    return reports.select(*(F.col(f"{f.name}.{m.name}").alias(f"{f.name}_{m.name}") for f in reports.schema.fields for m in f.dataType.fields))


ALL_HOLDINGS = dict(nulls="dq_holdings_nulls", gains="dq_gain_loss_check", dates="dq_date_range", values="dq_value_summary", complete="dq_completeness")


def _all_sql() -> str:
    """The five reports side by side, each by its own SQL."""
    parts = {name: f"(SELECT COLUMNS('(.*)') AS '{name}_\\1' FROM ({ORACLES[key]}))" for name, key in ALL_HOLDINGS.items()}
    return "SELECT * FROM " + " CROSS JOIN ".join(parts.values())


@query("dq_holdings_all", _all_sql())
def _(t):
    """Five reports of the holdings by one scan."""
    rows = metrics(t)
    return plain(flat(q.together(rows, dict(nulls=q.holdings_null_measures(), gains=q.gain_loss_measures(), dates=q.date_range_measures(AS_OF_MARKET),
                                            values=q.value_measures(), complete=q.completeness_measures(COMPLETE)))))


@query("dq_completeness_clients", using("clients") + """SELECT count(*) AS total_holdings,
    CAST(ROUND(count(client_tier) * 100.0 / count(*), 2) AS DOUBLE) AS pct_tier,
    CAST(ROUND(count(dq_status) * 100.0 / count(*), 2) AS DOUBLE) AS pct_dq FROM clients""")
def _(t):
    return plain(q.completeness(t.clients(), {"pct_tier": "client_tier", "pct_dq": "dq_status"}))


@query("dq_summary_view_profile", using(*SUMMARY_INPUTS, s=SUMMARY) + """SELECT count(*) AS total_records,
    count(DISTINCT portfolio_id) AS unique_portfolios, count(DISTINCT security_id) AS unique_securities,
    min(as_of_date) AS earliest_date, max(as_of_date) AS latest_date FROM s""")
def _(t):
    return q.summary_profile(summary(t))


def _health(name, expected, needed, actual, source, details):
    test = f"actual = {expected}" if needed is None else f"actual >= {needed}"
    return (f"SELECT '{name}' AS component, CAST({expected} AS BIGINT) AS expected, actual, CASE WHEN {test} THEN 'HEALTHY' "
            f"ELSE 'CHECK' END AS status, '{details}' AS details FROM (SELECT {actual} AS actual FROM {source})")


HEALTH = [
    ("Warehouses in use", 4, 4, "count(DISTINCT warehouse_name)",
     f"qh WHERE warehouse_name LIKE 'INV_%' AND start_time >= DATE '{AS_OF_LOG.date()}' - 30", "Dedicated warehouses"),
    ("DIM_SECURITY", 500, 400, "count(*)", "part", "Securities master"),
    ("DIM_PORTFOLIO", 50, 40, "count(*)", "dim_portfolio", "Portfolios master"),
    ("FACT_HOLDINGS", 5000, 4000, "count(*)", "positions", "Holdings fact table"),
    ("FACT_NAV_HISTORY", 2000, 1500, "count(*)", "nav_day", "NAV history fact"),
    ("Data quality", 0, None, "count(*)", "positions WHERE cost_basis IS NULL OR market_value IS NULL", "No NULL key values"),
]


@query("dq_health_report", using("qh", "dim_portfolio", "positions", "nav_day") + " UNION ALL ".join(_health(*h) for h in HEALTH))
def _(t):
    from tidemark.functions.clock import day_start
    used = t.query_history().where(F.col("warehouse_name").like("INV_%") & (F.col("start_time") >= day_start(AS_OF_LOG, 30)))
    count = F.count("*").alias("actual")
    positions, nav = t.positions(), t.trades().select("portfolio_id", "trade_date").distinct()
    measured = [used.agg(F.count_distinct("warehouse_name").alias("actual")), t.raw("part").agg(count),
                t.dim_portfolio().agg(count), positions.agg(count), nav.agg(count),
                positions.where("cost_basis IS NULL OR market_value IS NULL").agg(count)]
    return q.health_report([(h[0], h[1], h[2], m, h[5]) for h, m in zip(HEALTH, measured)])


@query("dq_unique_keys", using("trades") + """SELECT order_id, line_no, count(*) AS copies FROM trades GROUP BY 1, 2
    HAVING count(*) > 1""")
def _(t):
    return q.unique_keys(t.trades(), ["order_id", "line_no"])
