"""Repeatable samples."""

from pyspark.sql import functions as F

from tidemark.operators import sampling as s
from tidemark.plans.registry import plain, query
from tidemark.plans.sqlbase import d, using


def _hash(*key: str, salt: str = "") -> str:
    text = " || '|' || ".join([f"'{salt}'", *(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in key)])
    return f"CAST(('0x' || left(md5({text}), 15)) AS BIGINT)"


@query("sample_securities_random_order", using("dim_security", h=f"SELECT *, {_hash('security_id', salt='pick')} AS h FROM dim_security WHERE is_current")
       + "SELECT security_id, ticker, security_type, row_number() OVER (ORDER BY h, security_id) AS place FROM h ORDER BY h, security_id LIMIT 100")
def _(t):
    current = t.dim_security().where("is_current").select("security_id", "ticker", "security_type")
    return s.random_order(current, ["security_id"], 100, "pick")


POSITION = ("as_of_date", "portfolio_id", "security_id")


@query("sample_positions_per_portfolio", using("lots", h=f"""SELECT trade_date AS as_of_date, portfolio_id, security_id, quantity, market_value,
      {_hash('trade_date', 'portfolio_id', 'security_id')} AS h FROM lots""") + f"""SELECT as_of_date, portfolio_id, security_id, CAST(quantity AS BIGINT) AS quantity,
    {d('market_value')}, row_number() OVER (PARTITION BY portfolio_id ORDER BY h, as_of_date, security_id) AS place FROM h QUALIFY place <= 5""")
def _(t):
    lots = t.trades().withColumnRenamed("trade_date", "as_of_date").groupBy(*POSITION).agg(
        F.sum("quantity").alias("quantity"), F.sum("net").alias("market_value"))
    return plain(s.random_per_group(lots, ["portfolio_id"], POSITION, 5))


@query("sample_trades_bernoulli", using("trades", h=f"SELECT *, {_hash('order_id', 'line_no', salt='share')} AS h FROM trades") + f"""SELECT order_id, line_no,
    security_id, {d('gross')}, h < {int(0.05 * (1 << 60))} AS in_five_percent FROM h WHERE h < {int(0.1 * (1 << 60))}""")
def _(t):
    """A tenth of the trades, and which of them make the twentieth that the same salt draws."""
    key = ["order_id", "line_no"]
    tenth = s.bernoulli(t.trades().select(*key, "security_id", "gross"), key, 0.1, "share")
    return plain(tenth.withColumn("in_five_percent", s.in_share(key, 0.05, "share")))
