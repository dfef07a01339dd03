"""Hand-made edge cases for prices, holdings, rankings, history and features."""

import datetime as dt
import random
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS
from tidemark.operators import dims, features, gold, history, ranking, silver, training
from tidemark.sources import loads

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def portfolios(spark, ids):
    return spark.createDataFrame([(i, f"P{i}", "ETF", "GROWTH", True) for i in ids],
                                 "portfolio_id bigint, portfolio_name string, portfolio_type string, strategy string, is_active boolean")


def brute_performance(days, counts):
    """Row by row: the frame is the last 30 rows of the joined bag."""
    bag, out = [], []
    for day, r in days:
        for _ in range(counts[day]):
            bag.append(r)
            frame = [x for x in bag[-30:] if x is not None]
            mean = statistics.fmean(frame) * 252 if frame else None
            vol = statistics.stdev(frame) * math.sqrt(252) if len(frame) > 1 else None
            out.append((day, mean, vol))
    return out


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_performance_frame_counts_positions(spark, monkeypatch, chunk):
    monkeypatch.setattr(gold, "CHUNK", chunk)
    days = [(D(2024, 1, i), None if i == 1 else 0.01 * ((i * 7) % 5 - 2)) for i in range(1, 13)]
    counts = {day: [1, 3, 65, 2, 29, 30, 31, 1, 1, 12, 100, 4][i] for i, (day, _) in enumerate(days)}
    nav = spark.createDataFrame([(1, d, 10.0, 1.0, r, 0.0, 0.0) for d, r in days],
                                "portfolio_id bigint, as_of_date date, nav_per_share double, total_nav double, daily_return double, "
                                "mtd_return double, ytd_return double")
    held = spark.createDataFrame([(1, d, s) for d, n in counts.items() for s in range(n)],
                                 "portfolio_id bigint, as_of_date date, security_id bigint")
    got = gold.portfolio_performance(nav, held, portfolios(spark, [1])).select(
        "as_of_date", "annualized_30d_return", "annualized_30d_volatility").collect()
    want = brute_performance(days, counts)
    assert tidy(got) == tidy(want)
    assert gold.portfolio_performance(nav, held, portfolios(spark, [1]), dedupe=True).count() == len(days)


def tidy(rs):
    cut = [tuple(x if x is None or isinstance(x, dt.date) else round(x, 6) + 0.0 for x in r) for r in rs]
    return sorted(cut, key=lambda r: [(x is None, x) for x in r])


def test_sliced_row_number_equals_window(spark):
    data = [("hot", i, float((i * 37) % 101) - 20.0 if i % 11 else None) for i in range(400)] + [("cold", i, 5.0) for i in range(3)]
    df = spark.createDataFrame(data, "g string, id bigint, v double")
    plain = {(r.g, r.id): r.n for r in df.withColumn("n", F.expr(
        "row_number() over (partition by g order by v desc nulls last, id)")).collect()}
    for large in (10, 1_000_000, 1):
        cut = {(r.g, r.id): r.n for r in ranking.sliced_row_number(df, ["g"], "v", ["id"], "n", large=large).collect()}
        assert cut == plain


def test_risk_of_one_row_and_var_order(spark):
    nav = spark.createDataFrame([(1, D(2024, 1, 2), 0.5)] + [(2, D(2024, 1, 1) + dt.timedelta(i), 0.01 * (i % 9 - 4)) for i in range(60)],
                                "portfolio_id bigint, as_of_date date, daily_return double")
    got = {r.portfolio_id: r for r in gold.portfolio_risk(nav, D(2024, 6, 1)).collect()}
    assert got[1].annualized_volatility is None and got[1].sharpe_ratio is None and got[1].var_95_daily == 0.5
    assert got[2].worst_daily_return <= got[2].var_99_daily <= got[2].var_95_daily
    lower = {r.portfolio_id: r for r in gold.portfolio_risk(nav, D(2024, 6, 1), risk_free=0.1).collect()}
    assert lower[2].sharpe_ratio < got[2].sharpe_ratio


def test_zero_spread_has_no_sharpe(spark):
    nav = spark.createDataFrame([(1, D(2024, 1, i), 0.0) for i in range(1, 5)], "portfolio_id bigint, as_of_date date, daily_return double")
    assert gold.portfolio_risk(nav, D(2024, 2, 1)).first().sharpe_ratio is None


def test_metrics_guard_zero_cost(spark):
    df = spark.createDataFrame([(100.0, 0.0, 10), (110.0, 100.0, 365), (None, 1.0, 1)], "market_value double, cost_basis double, holding_period_days int")
    got = rows(silver.holdings_metrics(df).select("gain_loss_pct", "annualized_return"))
    assert got[0] == (None, None) and got[2] == (None, None)
    assert got[1] == pytest.approx((10.0, 10.0))
    other = silver.holdings_metrics(df, pct_on_market_value=True).collect()[1]
    assert other.gain_loss_pct == pytest.approx((1 - 100 / 110) * 100) and other.annualized_return == pytest.approx(10.0)


def test_dedupe_keeps_latest_and_limits_before_shuffle(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4)], "k string, t int, id int")
    out = silver.dedupe_latest(df, ["k"], ["t", "id"])
    assert rows(out, "k") == [("a", 2, 3), ("b", 1, 4)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_identifier_priority(spark):
    dim = spark.createDataFrame([(1, "I1", "C1"), (2, "I2", "C1"), (3, None, "C3")], "security_id bigint, isin string, cusip string")
    rec = spark.createDataFrame([(10, "I2", "C3"), (11, "??", "C1"), (12, None, None), (13, "??", "??")], "rid bigint, isin string, cusip string")
    got = rows(silver.map_identifiers(rec, dim, "rid", ["isin", "cusip"]).select("rid", "security_id", "matched_on"), "rid")
    assert got == [(10, 2, "isin"), (11, 1, "cusip"), (12, None, None), (13, None, None)]


def test_currency_before_first_and_after_last_rate(spark):
    rates = spark.createDataFrame([("EUR", D(2024, 1, 5), 2.0), ("EUR", D(2024, 1, 8), 3.0)], "currency string, rate_date date, rate double")
    facts = spark.createDataFrame([("EUR", D(2024, 1, d), 10.0) for d in (4, 5, 7, 8, 20)] + [("XXX", D(2024, 1, 8), 1.0)],
                                  "currency string, trade_date date, amount double")
    out = silver.convert_currency(facts, rates, "amount", F.lit("2024-01-31").cast("date"))
    assert [r.amount_base for r in out.orderBy("currency", "trade_date").collect()] == [None, 20.0, 20.0, 30.0, 30.0, None]


def test_validate_is_a_partition(spark):
    df = spark.createDataFrame([("s", D(2024, 1, 1), 2.0, 1.0, 1.5, "USD"), ("s", None, 1.0, 2.0, -1.0, "USDX"), (None, D(2024, 1, 1), None, 1.0, 1.0, None)],
                               "security_id string, trade_date date, high_price double, low_price double, close_price double, currency string")
    checked = silver.validate(df, silver.price_rules())
    good, bad = silver.split_valid(checked)
    assert good.count() == 1 and bad.count() == 2
    reasons = sorted(sorted(r.failed_rules) for r in bad.collect())
    assert reasons == [["close_positive", "currency_is_iso", "high_not_below_low", "trade_date_present"],
                       ["currency_is_iso", "high_not_below_low", "security_id_present"]]


CHANGES = "key bigint, attribute string, changed_at timestamp_ntz, change_id bigint"


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_scd2_versions_do_not_overlap_and_merge_equals_build(spark):
    log = [(1, "A", ts(1), 1), (1, "A", ts(2), 2), (1, "B", ts(3, 9), 3), (1, "C", ts(3, 10), 4), (2, None, ts(1), 5), (2, "X", ts(5), 6),
           (1, "A", ts(9), 7), (3, "Q", ts(4), 8)]
    args = ("key", ["attribute"], "changed_at", "change_id")
    full = history.scd2_build(spark.createDataFrame(log, CHANGES), *args)
    end = dt.datetime(9999, 12, 31)
    assert rows(full.select("key", "attribute", "effective_from", "effective_to", "is_current"), "key", "effective_from") == [
        (1, "A", ts(1), ts(3), False), (1, "C", ts(3), ts(9), False), (1, "A", ts(9), end, True),
        (2, None, ts(1), ts(5), False), (2, "X", ts(5), end, True), (3, "Q", ts(4), end, True)]
    # merge in two orders; the second has a change older than what is stored
    for late in ({3, 4, 7}, {1, 2, 5}):
        first = history.scd2_build(spark.createDataFrame([c for c in log if c[3] not in late], CHANGES), *args)
        merged = history.scd2_merge(first, spark.createDataFrame([c for c in log if c[3] in late], CHANGES), *args)
        assert rows(merged, "key", "effective_from") == rows(full.select(merged.columns), "key", "effective_from")


def test_point_in_time_edges(spark):
    log = [(1, "A", ts(10), 1), (1, "B", ts(20), 2)]
    ver = history.scd2_build(spark.createDataFrame(log, CHANGES), "key", ["attribute"], "changed_at", "change_id")
    facts = spark.createDataFrame([(1, ts(9)), (1, ts(10)), (1, ts(19, 23)), (1, ts(20)), (1, dt.datetime(2030, 5, 5)), (2, ts(15))],
                                  "key bigint, at timestamp_ntz")
    for as_of in (D(2024, 1, 12), D(2024, 3, 1), D(2031, 1, 1)):
        got = rows(history.point_in_time(facts, ver, "key", "at", as_of).select("at", "attribute"), "at")
        assert got == [(ts(10), "A"), (ts(19, 23), "A"), (ts(20), "B"), (dt.datetime(2030, 5, 5), "B")]


def test_snapshot_rerun_replaces_its_date(spark, tmp_path):
    path = str(tmp_path / "snap")
    for n, day in ((3, "2024-01-31"), (5, "2024-02-29"), (4, "2024-01-31")):
        loads.write_snapshot(spark.range(n), path, day)
    assert loads.read_snapshot(spark, path, "2024-02-10").count() == 4
    assert loads.read_snapshot(spark, path, "2024-03-10").count() == 5
    assert loads.read_snapshot(spark, path, "2023-01-01").count() == 0


def test_full_reload_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, 2023), (2, 2024)], "x int, y int")
    loads.full_reload(old, path, ["value", "year"], "year")
    loads.full_reload(spark.createDataFrame([(9, 2024)], "x int, y int"), path, ["value", "year"], "year")
    assert rows(loads.loaded(spark, path).select("value", "year"), "year") == [(1, 2023), (9, 2024)]
    with pytest.raises(ValueError):
        loads.positional(old, ["only_one"])


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contracts_conform(spark, name):
    contract = CONTRACTS[name]
    out = loads.conform(spark.range(1), contract, ["id"])
    assert out.columns == contract.columns
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in contract.schema.fields]
    for column, value in contract.defaults.items():
        assert out.first()[column] in (value, dt.datetime(9999, 12, 31))
    if contract.required:
        assert loads.missing_required(out, contract).count() == 1


def test_calendar(spark):
    cal = {r.calendar_date: r for r in dims.dim_date(spark, D(2022, 1, 1), 1461, D(2024, 3, 1)).collect()}
    assert max(cal) == D(2024, 3, 1) and len(cal) == 791
    assert cal[D(2022, 1, 1)].day_of_week == 6 and cal[D(2022, 1, 1)].is_weekend and cal[D(2022, 1, 1)].week_of_year == 52
    assert cal[D(2022, 1, 2)].day_of_week == 0 and cal[D(2024, 2, 29)].is_month_end and not cal[D(2024, 2, 29)].is_quarter_end
    assert cal[D(2022, 12, 31)].is_year_end and cal[D(2022, 12, 31)].is_quarter_end and cal[D(2022, 5, 9)].month_name == "May"
    closed = spark.createDataFrame([(D(2022, 7, 4),)], "calendar_date date")
    day = {r.calendar_date: r for r in dims.dim_date(spark, D(2022, 7, 1), 7, D(2023, 1, 1), closed).collect()}
    assert not day[D(2022, 7, 4)].is_us_trading_day and day[D(2022, 7, 5)].is_us_trading_day
    assert dims.dim_date(spark, D(2022, 1, 1), 10, D(2021, 1, 1)).count() == 0


def bars(spark, closes):
    return spark.createDataFrame([("s", D(2024, 1, 1) + dt.timedelta(i), c, c, c, 10 + i) for i, c in enumerate(closes)],
                                 "security_id string, trade_date date, close_price double, high_price double, low_price double, volume bigint")


def test_price_features_by_hand(spark):
    closes = [10.0, 11.0, 9.0, 12.0, 12.0, 6.0]
    got = features.price_features(bars(spark, closes)).orderBy("feature_date").collect()
    fast, slow, sig = closes[0], closes[0], 0.0
    for i, c in enumerate(closes):
        if i:
            fast, slow = fast + 2 / 13 * (c - fast), slow + 2 / 27 * (c - slow)
            sig += 0.2 * (fast - slow - sig)
        assert (got[i].ema_12, got[i].ema_26, got[i].macd_signal) == pytest.approx((fast, slow, sig))
        assert got[i].sma_5 == pytest.approx(statistics.fmean(closes[max(0, i - 4):i + 1]))
        assert got[i].high_52w == max(closes[:i + 1]) and got[i].low_52w == min(closes[:i + 1])
    assert got[0].daily_return is None and got[0].rsi_14 is None and got[1].rsi_14 == 100.0
    assert got[2].rsi_14 == pytest.approx(100 - 100 / (1 + 1 / 2))


def test_labels_and_split_do_not_look_ahead(spark):
    lab = training.labels(bars(spark, [float(i) for i in range(1, 31)])).orderBy("trade_date").collect()
    assert lab[0].forward_return_5d == 5.0 and lab[0].direction_5d == 1
    assert lab[25].forward_return_5d is None and lab[25].direction_5d is None and lab[10].forward_return_20d is None
    out = training.split(bars(spark, [1.0] * 10), D(2024, 1, 3), D(2024, 1, 5)).orderBy("trade_date")
    assert [r.split for r in out.collect()] == ["train"] * 3 + ["validation"] * 2 + ["test"] * 5
    feats = spark.createDataFrame([("s", D(2024, 1, 2), 1.0), ("s", D(2024, 1, 4), 2.0)], "security_id string, trade_date date, f double")
    got = training.as_of_features(bars(spark, [1.0] * 5).select("security_id", "trade_date", "close_price"), feats, ["f"]).orderBy("trade_date")
    assert [(r.f, r.feature_date) for r in got.collect()] == [
        (None, None), (1.0, D(2024, 1, 2)), (1.0, D(2024, 1, 2)), (2.0, D(2024, 1, 4)), (2.0, D(2024, 1, 4))]


def test_drawdown(spark):
    nav = spark.createDataFrame([(1, D(2024, 1, i + 1), v) for i, v in enumerate([10.0, 8.0, 12.0, 6.0, 9.0])],
                                "portfolio_id bigint, as_of_date date, nav_per_share double")
    got = [r.max_drawdown_60d for r in features.max_drawdown(nav).orderBy("as_of_date").collect()]
    assert got == pytest.approx([0.0, -0.2, -0.2, -0.5, -0.5])
    short = [r.max_drawdown_2d for r in features.max_drawdown(nav, 2).orderBy("as_of_date").collect()]
    assert short == pytest.approx([0.0, -0.2, 0.0, -0.5, 0.0])


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_drawdown_by_blocks_equals_every_pair(spark, n):
    rng = random.Random(n)
    rows = [(p, D(2024, 1, 1) + dt.timedelta(days=i), rng.choice([None, *[float(rng.randint(1, 50))] * 9])) for p in (1, 2, 3) for i in range(1 if p == 3 else 150)]
    rng.shuffle(rows)
    nav = spark.createDataFrame(rows, "portfolio_id bigint, as_of_date date, nav_per_share double")
    found = features.max_drawdown(nav, n)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    for p in (1, 2, 3):
        values = [v for _, v in sorted((d, v) for q, d, v in rows if q == p)]
        expected = []
        for i in range(len(values)):
            own = [v for v in values[max(0, i - n + 1):i + 1] if v is not None]
            expected.append(min([own[k] / max(own[:k + 1]) - 1.0 for k in range(len(own))], default=0.0))
        got = [r[f"max_drawdown_{n}d"] for r in found.where(f"portfolio_id = {p}").orderBy("as_of_date").collect()]
        assert got == expected
