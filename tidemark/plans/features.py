"""Features, labels, training sets, back-test. Technical features use the long brand series."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import features as f, nav as n, refresh, silver, training as tr
from tidemark.plans.registry import plain, query
from tidemark.plans.sqlbase import LAST60, NAV_W, r, single, using
from tidemark.sources import versions
from tidemark.sources.scratch import scratch_path

W = "PARTITION BY security_id ORDER BY trade_date"


def rows(k: int, w: str = W) -> str:
    return f"({w} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


KEY = "security_id, trade_date, close_price"
RET = dict(ret=f"SELECT *, close_price / lag(close_price) OVER ({W}) - 1.0 AS daily_return, "
               f"close_price / lag(close_price) OVER ({W}) AS growth, close_price - lag(close_price) OVER ({W}) AS change FROM brand_prices")


def cols(df, *names):
    return df.select("security_id", "trade_date", "close_price", *names)


@query("feat_returns", using("brand_prices", **RET) + f"SELECT {KEY}, daily_return, {r('ln(growth)', 9, 'log_return')} FROM ret")
def _(t):
    return plain(cols(f.returns(t.brand_prices()), "daily_return", "log_return"), log_return=9)


SPANS = (5, 20, 50, 200)


@query("feat_sma", using("brand_prices") + f"SELECT {KEY}, " + ", ".join(
    single(f"avg(close_price) OVER {rows(k)}", f"sma_{k}") for k in SPANS) + " FROM brand_prices")
def _(t):
    return plain(cols(f.sma(t.brand_prices()), *[f"sma_{k}" for k in SPANS]), **{f"sma_{k}": None for k in SPANS})


# exponential averages by recursion over each series
EMA = dict(
    seq=f"SELECT security_id, trade_date, close_price, row_number() OVER ({W}) AS i FROM brand_prices",
    ema="""SELECT security_id, i, trade_date, close_price, close_price AS e12, close_price AS e26, 0.0::DOUBLE AS macd,
        0.0::DOUBLE AS sig FROM seq WHERE i = 1 UNION ALL SELECT s.security_id, s.i, s.trade_date, s.close_price,
        s.close_price * (2.0::DOUBLE / 13) + e.e12 * (11.0::DOUBLE / 13), s.close_price * (2.0::DOUBLE / 27) + e.e26 * (25.0::DOUBLE / 27),
        (s.close_price * (2.0::DOUBLE / 13) + e.e12 * (11.0::DOUBLE / 13)) - (s.close_price * (2.0::DOUBLE / 27) + e.e26 * (25.0::DOUBLE / 27)),
        ((s.close_price * (2.0::DOUBLE / 13) + e.e12 * (11.0::DOUBLE / 13)) - (s.close_price * (2.0::DOUBLE / 27) + e.e26 * (25.0::DOUBLE / 27)))
          * 0.2::DOUBLE + e.sig * 0.8::DOUBLE
        FROM ema e JOIN seq s ON s.security_id = e.security_id AND s.i = e.i + 1""")
EMA_WITH = using("brand_prices", **EMA).replace("WITH ", "WITH RECURSIVE ", 1)


@query("feat_ema", EMA_WITH + f"SELECT {KEY}, {r('e12', 4, 'ema_12')}, {r('e26', 4, 'ema_26')} FROM ema")
def _(t):
    return plain(cols(f.ema_macd(t.brand_prices()), "ema_12", "ema_26"), ema_12=4, ema_26=4)


@query("feat_macd", EMA_WITH + f"SELECT {KEY}, {r('macd', 4, 'macd')}, {r('sig', 4, 'macd_signal')} FROM ema")
def _(t):
    return plain(cols(f.ema_macd(t.brand_prices()), "macd", "macd_signal"), macd=4, macd_signal=4)


@query("feat_volatility", using("brand_prices", **RET) + f"SELECT {KEY}, " + ", ".join(
    r(f"stddev_samp(daily_return) OVER {rows(k)}", 3, f"volatility_{k}d") for k in (20, 60)) + " FROM ret")
def _(t):
    return plain(cols(f.volatility(f.returns(t.brand_prices())), "volatility_20d", "volatility_60d"),
                 volatility_20d=3, volatility_60d=3)


GAINS = dict(gl=f"""SELECT *, avg(greatest(change, 0)) OVER {rows(14)} AS gain, avg(greatest(-change, 0)) OVER {rows(14)} AS loss,
    count(change) OVER {rows(14)} AS n FROM ret""")


@query("feat_rsi", using("brand_prices", **RET, **GAINS)
    + f"""SELECT {KEY}, {r('CASE WHEN n > 0 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END END', 6, 'rsi_14')}
    FROM gl""")
def _(t):
    return plain(cols(f.rsi(t.brand_prices()), "rsi_14"), rsi_14=6)


@query("feat_volume", using("brand_prices") + f"""SELECT {KEY}, volume, {r(f'avg(volume) OVER {rows(20)}', 6, 'volume_sma_20')},
    {r(f'volume / avg(volume) OVER {rows(20)}', 7, 'volume_ratio')} FROM brand_prices""")
def _(t):
    return plain(cols(f.volume(t.brand_prices()), "volume", "volume_sma_20", "volume_ratio"), volume_sma_20=6, volume_ratio=7)


YEAR = f"({W} RANGE BETWEEN INTERVAL 363 DAY PRECEDING AND CURRENT ROW)"


@query("feat_52w", using("brand_prices") + f"""SELECT {KEY}, max(high_price) OVER {YEAR} AS high_52w, min(low_price) OVER {YEAR} AS low_52w,
    close_price / max(high_price) OVER {YEAR} - 1.0 AS pct_from_high FROM brand_prices""")
def _(t):
    return cols(f.range_52w(t.brand_prices()), "high_52w", "low_52w", "pct_from_high")


PRICE_ALL = f"""SELECT security_id, trade_date AS feature_date, open_price, high_price, low_price, close_price, volume, vwap, daily_return,
    {r('ln(growth)', 9, 'log_return')}, {', '.join(single(f'avg(close_price) OVER {rows(k)}', f'sma_{k}') for k in SPANS)},
    {', '.join(r(f'stddev_samp(daily_return) OVER {rows(k)}', 3, f'volatility_{k}d') for k in (20, 60))},
    {r('CASE WHEN n > 0 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END END', 6, 'rsi_14')},
    {r(f'avg(volume) OVER {rows(20)}', 6, 'volume_sma_20')}, {r(f'volume / avg(volume) OVER {rows(20)}', 7, 'volume_ratio')},
    max(high_price) OVER {YEAR} AS high_52w, min(low_price) OVER {YEAR} AS low_52w,
    close_price / max(high_price) OVER {YEAR} - 1.0 AS pct_from_high, {r('e12', 4, 'ema_12')}, {r('e26', 4, 'ema_26')},
    {r('macd', 4, 'macd')}, {r('sig', 4, 'macd_signal')} FROM gl JOIN ema USING (security_id, trade_date, close_price)"""


@query("feat_price_all", using("brand_prices", **RET, **GAINS, **EMA).replace("WITH ", "WITH RECURSIVE ", 1) + PRICE_ALL)
def _(t):
    return plain(f.price_features(t.brand_prices()), log_return=9, **{f"sma_{k}": None for k in SPANS}, volatility_20d=3, volatility_60d=3,
                 rsi_14=6, volume_sma_20=6, volume_ratio=7, ema_12=4, ema_26=4, macd=4, macd_signal=4)


# --- portfolios -----------------------------------------------------------------------------------

def sectors(t):
    return t.dim_security().select("security_id", "sector")


COMPOSITION = dict(
    ranked="""SELECT *, row_number() OVER (PARTITION BY portfolio_id, trade_date ORDER BY market_value DESC, security_id) AS rn FROM lots""",
    sec="""SELECT portfolio_id, trade_date, sector, sum(market_value) AS mv FROM lots JOIN dim_security USING (security_id) GROUP BY 1, 2, 3""",
    hhi="""SELECT portfolio_id, trade_date, sum(CAST(mv AS DOUBLE) * CAST(mv AS DOUBLE)) / (CAST(sum(mv) AS DOUBLE) * CAST(sum(mv) AS DOUBLE))
      AS sector_hhi FROM sec GROUP BY 1, 2""",
    comp=f"""SELECT portfolio_id, trade_date AS as_of_date, count(*) AS num_positions,
      CAST(sum(market_value) FILTER (rn <= 5) AS DOUBLE) / CAST(sum(market_value) AS DOUBLE) AS concentration_top5,
      CAST(sum(market_value) FILTER (rn <= 10) AS DOUBLE) / CAST(sum(market_value) AS DOUBLE) AS concentration_top10,
      {r('any_value(sector_hhi)', 7, 'sector_hhi')} FROM ranked JOIN hhi USING (portfolio_id, trade_date) GROUP BY 1, 2""")


@query("feat_portfolio_composition", using("lots", "dim_security", **COMPOSITION) + "SELECT * FROM comp")
def _(t):
    lots = t.trades().groupBy(F.col("trade_date").alias("as_of_date"), "portfolio_id", "security_id").agg(
        F.sum("net").alias("market_value"))
    return plain(f.composition(lots, sectors(t)), sector_hhi=7)


def series(t):
    return n.benchmark_return(n.daily_return(t.benchmarked_nav()))


@query("feat_portfolio_returns", using("nav") + "SELECT portfolio_id, as_of_date, " + ", ".join(
    f"nav_per_share / lag(nav_per_share, {k}) OVER ({NAV_W}) - 1.0 AS return_{k}d" for k in (1, 5, 20, 60)) + " FROM nav")
def _(t):
    return f.portfolio_returns(t.nav()).select("portfolio_id", "as_of_date", *[f"return_{k}d" for k in (1, 5, 20, 60)])


RISK = dict(volatility_20d=3, volatility_60d=3, sharpe_60d=3, beta_to_benchmark=3)


RISK_SQL = f"""{r(f'stddev_samp(daily_return) OVER {rows(20, NAV_W)}', 3, 'volatility_20d')},
    {r(f'stddev_samp(daily_return) OVER {LAST60}', 3, 'volatility_60d')},
    {r(f'avg(daily_return) OVER {LAST60} * 252 / NULLIF(stddev_samp(daily_return) OVER {LAST60} * sqrt(252), 0)', 3, 'sharpe_60d')},
    {r(f'covar_samp(daily_return, benchmark_return) OVER {LAST60} / NULLIF(var_samp(benchmark_return) OVER {LAST60}, 0)', 3, 'beta_to_benchmark')}"""


@query("feat_portfolio_risk", using("nav_r") + f"SELECT portfolio_id, as_of_date, {RISK_SQL} FROM nav_r")
def _(t):
    return plain(f.portfolio_risk(series(t)).select("portfolio_id", "as_of_date", *RISK), **RISK)


FALLS = dict(
    spans=f"SELECT portfolio_id, as_of_date, list(nav_per_share) OVER ({NAV_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v FROM nav",
    draw="""SELECT portfolio_id, as_of_date, list_min(list_transform(range(1, len(v) + 1), lambda j: v[j] / list_max(v[1:j]) - 1.0)) + 0.0
      AS max_drawdown_60d FROM spans""")


@query("feat_max_drawdown", using("nav", **FALLS) + "SELECT * FROM draw")
def _(t):
    return f.max_drawdown(t.nav()).select("portfolio_id", "as_of_date", "max_drawdown_60d")


BACK = ", ".join(f"nav_per_share / lag(nav_per_share, {k}) OVER ({NAV_W}) - 1.0 AS return_{k}d" for k in (1, 5, 20, 60))
PORTFOLIO_COLUMNS = ["portfolio_id", "feature_date", "num_positions", "concentration_top5", "concentration_top10", "sector_hhi",
                     *[f"return_{k}d" for k in (1, 5, 20, 60)], *RISK, "max_drawdown_60d"]


@query("feat_portfolio_all", using("nav_r", "lots", "dim_security", **COMPOSITION, **FALLS, rk=f"SELECT portfolio_id, as_of_date, {RISK_SQL}, {BACK} FROM nav_r")
       + "SELECT * RENAME (as_of_date AS feature_date) FROM rk JOIN comp USING (portfolio_id, as_of_date) JOIN draw USING (portfolio_id, as_of_date)")
def _(t):
    return plain(f.portfolio_features(series(t), t.positions(), sectors(t)).select(PORTFOLIO_COLUMNS), sector_hhi=7, **RISK)


# --- training -------------------------------------------------------------------------------------

@query("feat_lagged", using("brand_prices", **RET) + f"SELECT {KEY}, daily_return, " + ", ".join(
    f"lag(daily_return, {k}) OVER ({W}) AS daily_return_lag{k}" for k in (1, 2, 3)) + " FROM ret")
def _(t):
    return cols(tr.lagged(f.returns(t.brand_prices()), ["daily_return"]), "daily_return", *[f"daily_return_lag{k}" for k in (1, 2, 3)])


LABELS = dict(lab=f"""SELECT {KEY}, lead(close_price, 5) OVER ({W}) / close_price - 1.0 AS forward_return_5d,
    lead(close_price, 20) OVER ({W}) / close_price - 1.0 AS forward_return_20d FROM brand_prices""")
DIRECTION = "CASE WHEN forward_return_5d IS NOT NULL THEN CAST(forward_return_5d > 0 AS BIGINT) END AS direction_5d"


@query("train_labels", using("brand_prices", **LABELS) + f"SELECT *, {DIRECTION} FROM lab")
def _(t):
    return cols(tr.labels(t.brand_prices()), "forward_return_5d", "forward_return_20d", "direction_5d")


# ties between the averages are decided before the last digits, so both engines see the same crossing
SMA = dict(sma=f"""SELECT {KEY}, {single(f'avg(close_price) OVER {rows(5)}', 'sma_5')},
    {single(f'avg(close_price) OVER {rows(20)}', 'sma_20')} FROM brand_prices""", side="SELECT *, sign(sma_5 - sma_20) AS s FROM sma")


@query("train_sma_cross", using("brand_prices", **SMA) + f"""SELECT security_id, trade_date, sma_5, sma_20, CASE
    WHEN s > 0 AND lag(s) OVER ({W}) <= 0 THEN 1 WHEN s < 0 AND lag(s) OVER ({W}) >= 0 THEN -1 ELSE 0 END::BIGINT AS sma_cross FROM side""")
def _(t):
    averages = plain(f.sma(t.brand_prices(), (5, 20)), sma_5=None, sma_20=None)
    return tr.sma_cross(averages).select("security_id", "trade_date", "sma_5", "sma_20", "sma_cross")


# a day's features are known on the next; labels exist for every day
FEATURES = ["return_1d", "volume_ratio", "volatility_20d"]
KNOWN = dict(fe=f"""SELECT security_id, trade_date + 1 AS feature_date, daily_return AS return_1d, volume / avg(volume) OVER {rows(20)} AS volume_ratio,
    stddev_samp(daily_return) OVER {rows(20)} AS volatility_20d FROM ret""")
TRAIN = f"""SELECT lab.security_id, trade_date, forward_return_5d, forward_return_20d, {DIRECTION}, feature_date, return_1d,
    {r('volume_ratio', 7, 'volume_ratio')}, {r('volatility_20d', 3, 'volatility_20d')} FROM lab ASOF JOIN fe
    ON lab.security_id = fe.security_id AND lab.trade_date >= fe.feature_date WHERE forward_return_5d IS NOT NULL
    AND forward_return_20d IS NOT NULL AND return_1d IS NOT NULL AND volume_ratio IS NOT NULL AND volatility_20d IS NOT NULL"""


def training_set(t):
    prices = t.brand_prices()
    labelled = tr.labels(prices).select("security_id", "trade_date", "forward_return_5d", "forward_return_20d", "direction_5d")
    daily = f.volume(f.volatility(f.returns(prices), (20,)))
    known = daily.select(
        "security_id", F.date_add("trade_date", 1).alias("trade_date"), F.col("daily_return").alias("return_1d"), "volume_ratio", "volatility_20d")
    return plain(tr.dataset(labelled, known, FEATURES), volume_ratio=7, volatility_20d=3)


@query("train_dataset", using("brand_prices", **RET, **LABELS, **KNOWN) + TRAIN)
def _(t):
    return training_set(t)


@query("train_split", using("brand_prices", **RET, **LABELS, **KNOWN, ds=TRAIN) + """SELECT split, count(*) AS rows, min(trade_date) AS first_day,
    max(trade_date) AS last_day, CAST(sum(direction_5d) AS BIGINT) AS ups FROM (SELECT *, CASE WHEN trade_date <= DATE '1999-12-31' THEN 'train'
    WHEN trade_date <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END AS split FROM ds) GROUP BY split""")
def _(t):
    return tr.split(training_set(t), dt.date(1999, 12, 31), dt.date(2000, 12, 31)).groupBy("split").agg(
        F.count("*").alias("rows"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"),
        F.sum("direction_5d").alias("ups"))


@query("pred_backtest", using("brand_prices", **RET, **LABELS, pred="""SELECT security_id, trade_date, CASE WHEN daily_return > 0 THEN 1 ELSE 0 END
      AS predicted_direction, CASE WHEN length(security_id) > 7 THEN 'momentum' ELSE 'reversal' END AS model_name,
      'v' || CAST(volume % 3 AS VARCHAR) AS model_version, (volume % 101) / 100.0::DOUBLE AS confidence_score FROM ret WHERE daily_return IS NOT NULL""")
    + f"""SELECT model_name, model_version, CAST(least(floor(confidence_score * 10), 9) AS BIGINT) AS confidence_band, count(*) AS predictions,
    count(*) FILTER ((predicted_direction = 1) = (forward_return_5d > 0)) AS correct,
    CAST(count(*) FILTER ((predicted_direction = 1) = (forward_return_5d > 0)) AS DOUBLE) / count(*) AS accuracy,
    {r('avg(forward_return_5d)', 7, 'avg_actual_return')} FROM pred JOIN lab USING (security_id, trade_date)
    WHERE forward_return_5d IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    prices = t.brand_prices()
    predictions = f.returns(prices).where("daily_return IS NOT NULL").select(
        "security_id", F.col("trade_date").alias("prediction_date"), (F.col("daily_return") > 0).cast("bigint").alias("predicted_direction"),
        F.when(F.length("security_id") > 7, "momentum").otherwise("reversal").alias("model_name"),
        F.concat(F.lit("v"), (F.col("volume") % 3).cast("string")).alias("model_version"),
        ((F.col("volume") % 101) / 100.0).alias("confidence_score"))
    outcomes = tr.labels(prices).withColumnRenamed("forward_return_5d", "actual_return")
    return plain(tr.backtest(tr.realised(predictions, outcomes)), avg_actual_return=7)


LATE_FROM = "2001-03-01"
REFRESHED = ["security_id", "trade_date", "close_price", "daily_return", *[f"sma_{k}" for k in SPANS], "volatility_20d", "volatility_60d"]


@query("refresh_price_features", using("brand_prices", **RET) + f"SELECT {KEY}, daily_return, " + ", ".join(
    single(f"avg(close_price) OVER {rows(k)}", f"sma_{k}") for k in SPANS) + ", " + ", ".join(
    r(f"stddev_samp(daily_return) OVER {rows(k)}", 3, f"volatility_{k}d") for k in (20, 60)) + " FROM ret")
def _(t):
    """Features of the trades without the late ones, then renewed where late trades of the last months change them."""
    late = (F.col("order_id") % 97 == 0) & (F.col("trade_date") >= LATE_FROM)
    trades, keys = t.brand_trades(), ["security_id", "trade_date"]
    year = F.date_format("trade_date", "yyyy")
    bars_at, features_at = scratch_path(t.spark, "refresh-bars"), scratch_path(t.spark, "refresh-features")

    def bars(of):
        return silver.daily_prices(of, tie=["order_id", "line_no", "portfolio_id"]).withColumn("year", year)

    def features(of):
        return f.volatility(f.sma(f.returns(of))).select(*REFRESHED, "year", *[c for c in (refresh.STALE,) if c in of.columns])

    def stored(path, like):
        return versions.current(t.spark, path, like.schema).drop("part")
    first = bars(trades.where(~late))
    versions.publish(first, bars_at, "year")
    versions.publish(features(stored(bars_at, first)), features_at, "year")
    # the late trades: their days' bars, then what depends on them
    changed = trades.where(late).select(*keys).distinct()
    days = bars(trades.join(changed, keys, "left_semi"))
    years = changed.select(year.alias("part")).distinct()
    old = versions.current(t.spark, bars_at, first.schema).join(years, "part", "left_semi").drop("part")
    versions.publish(refresh.merged(old, days, changed, keys), bars_at, "year", years)
    table = features(first)
    new = refresh.renewed(stored(bars_at, first), changed, features, "security_id", "trade_date", max(SPANS))
    years = new.select(F.col("year").alias("part")).union(years).distinct()
    old = versions.current(t.spark, features_at, table.schema).join(years, "part", "left_semi").drop("part")
    versions.publish(refresh.merged(old, new, changed, keys), features_at, "year", years)
    return plain(stored(features_at, table).drop("year"), volatility_20d=3, volatility_60d=3, **{f"sma_{k}": None for k in SPANS})
