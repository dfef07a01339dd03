"""Plans that must hold at scale."""

import re

import pytest

from tidemark.plans import all_queries

QUERIES = all_queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("area", ["gold_", "silver_", "feat_", "train_", "audit_", "mon_", "dq_", "scd2_point", "scd2_build", "dim_", "tag_"])
def test_no_cartesian_or_nested_loop(spark, folder, area):
    for name, fn in QUERIES.items():
        if name.startswith(area):
            text = plan(fn(spark, folder))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_log_filters_reach_the_scan(spark, folder):
    text = plan(QUERIES["mon_failed"](spark, folder))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert "EqualTo(event_type,error)" in scan or "event_type#" in re.search(r"DataFilters: \[(.*?)\], Format", scan).group(1)
    assert "GreaterThanOrEqual(ts," in scan


def test_columns_are_pruned(spark, folder):
    text = plan(QUERIES["gold_portfolio_risk"](spark, folder))
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", text).group(1)))
    assert read == {"l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}
    assert text.count("FileScan") == 1


def test_top_k_is_cut_before_the_shuffle(spark, folder):
    for name in ("gold_top5_per_portfolio", "feat_portfolio_composition", "silver_dedupe"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, folder)), name
    assert "TakeOrderedAndProject" in plan(QUERIES["mon_top_expensive_queries"](spark, folder))


def test_rolling_features_share_one_shuffle(spark, folder):
    text = plan(QUERIES["silver_nav_period_returns"](spark, folder))
    assert text.count("Exchange hashpartitioning") == 2  # trades to portfolio-days, then to portfolios


def test_log_reports_need_one_shuffle(spark, folder):
    for name in ("mon_usage_7d", "mon_active_load"):
        assert plan(QUERIES[name](spark, folder)).count("Exchange") <= 2, name


def test_no_python_outside_the_recursive_averages(spark, folder):
    for name, fn in QUERIES.items():
        if name.startswith(("gold_", "silver_", "mon_", "audit_", "dq_", "mask_", "row_")):
            text = plan(fn(spark, folder))
            assert "Python" not in text and "Pandas" not in text, name


def test_reports_of_a_table_share_one_scan(spark, folder):
    together = plan(QUERIES["dq_holdings_all"](spark, folder))
    assert together.count("FileScan") == plan(QUERIES["dq_value_summary"](spark, folder)).count("FileScan")
    assert "lineitem.parquet" in together and together.count("lineitem.parquet") == 1


def test_summary_reads_trades_once(spark, folder, monkeypatch):
    """Trades are read for the lots, which positions, totals and NAV share, and by nothing else."""
    from tidemark.sources.bindings import Tables
    made = []
    written = Tables.written
    monkeypatch.setattr(Tables, "written", lambda self, name, make: written(self, name, lambda: made.append(plan(df := make())) or df))
    text = plan(QUERIES["gold_investment_summary"](spark, folder))
    assert "lineitem.parquet" not in text and sum(p.count("lineitem.parquet") for p in made) == 1
