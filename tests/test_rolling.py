"""Moments over trailing rows, NAV in parts, and joins that move rows once."""

import datetime as dt
import random
import re
import statistics

import pytest

from tidemark.operators import features, nav as navs, rolling
from tidemark.plans import all_queries
from tidemark.sources import bindings

QUERIES = all_queries()
START = dt.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_trailing_moments_equal_those_of_the_rows(spark, n):
    rng = random.Random(n)
    value = lambda: rng.choice([None, *[rng.uniform(-1, 1)] * 6])
    rows = [(p, START + dt.timedelta(days=i), value(), value()) for p in (1, 2, 3) for i in range(1 if p == 3 else 150)]
    rows += [(4, START + dt.timedelta(days=i), 0.1, rng.uniform(-1, 1)) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "p int, d date, x double, y double")
    found = rolling.trailing(df, "p", "d", n, "x", "y", "_m").select(
        "p", rolling.mean("_m", "x").alias("mean"), rolling.variance("_m", "x").alias("vx"), rolling.variance("_m", "y").alias("vy"),
        rolling.covariance("_m").alias("c"), "d").orderBy("p", "d").collect()
    rows.sort()
    near = lambda v: v if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)
    for i, got in enumerate(found):
        frame = [r for r in rows[max(0, i - n + 1):i + 1] if r[0] == rows[i][0]]
        x, y = ([r[k] for r in frame if r[k] is not None] for k in (2, 3))
        both = [(r[2], r[3]) for r in frame if None not in r]
        assert got.mean == near(statistics.fmean(x) if x else None)
        assert got.vx == near(statistics.variance(x) if len(x) > 1 else None)
        assert got.vy == near(statistics.variance(y) if len(y) > 1 else None)
        assert got.c == near(statistics.covariance(*zip(*both)) if len(both) > 1 else None)
        if rows[i][0] == 4 and len(frame) > 1:
            assert got.vx == 0.0 and got.c == 0.0


def test_constant_returns_have_no_sharpe_and_no_beta(spark):
    df = spark.createDataFrame([(1, START + dt.timedelta(days=i), 0.1, 0.3) for i in range(90)],
                               "portfolio_id bigint, as_of_date date, daily_return double, benchmark_return double")
    got = features.portfolio_risk(df).where("as_of_date > '2024-01-01'").collect()
    assert all(r.volatility_20d == r.volatility_60d == 0.0 and r.sharpe_60d is None and r.beta_to_benchmark is None for r in got)


@pytest.mark.parametrize("name", ["silver_nav_alpha_beta_60", "dq_nav_quality", "feat_portfolio_risk", "feat_portfolio_all"])
def test_no_frame_is_gone_through_for_every_row(spark, folder, name):
    assert not re.search(r"RowFrame, -(19|59), currentrow", plan(QUERIES[name](spark, folder)))


def test_market_from_trades_equals_market_from_nav(spark):
    rng = random.Random(5)
    trades = spark.createDataFrame(
        [(rng.choice([1, 2, None]), rng.choice([START, START + dt.timedelta(days=1), None]), rng.randint(1, 9)) for _ in range(60)],
        "portfolio_id bigint, trade_date date, quantity bigint").selectExpr("*", "cast(quantity * 1.25 + 0.5 as decimal(18,4)) as net")
    nav = navs.nav_from_trades(trades)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(navs.with_benchmark(nav, trades)) == rows(navs.with_benchmark(nav))


@pytest.mark.parametrize("name", ["feat_max_drawdown", "silver_nav_alpha_beta_60", "gold_sector_allocation", "gold_sector_totals"])
def test_parts_follow_the_size_of_the_trades(spark, folder, monkeypatch, name):
    monkeypatch.setattr(bindings, "PART", 4096)
    parts = [int(n) for n in re.findall(r"(\d+)\), REPARTITION_BY_NUM", plan(QUERIES[name](spark, folder)))]
    assert parts and min(parts) > 16


def test_summary_takes_positions_to_their_day_once(spark, folder):
    """Weight and NAV are joined in the same place, and what follows from other columns, or is text, does not travel there."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["gold_investment_summary"](spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in text.splitlines() if re.search(r"SortMergeJoin \[portfolio_id#\w+, as_of_date#\w+\]", line)]
    depths = sorted(len(line) - len(line.lstrip(" :+-")) for line in joins)
    assert len(joins) == 2 and depths[1] - depths[0] <= 6, text
