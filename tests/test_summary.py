"""The summary view moves each position twice, leaves nothing behind on the way, and keeps its rows in every case."""

import datetime as dt
import random
import re
import time
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from tidemark.functions.texts import packed, unpacked
from tidemark.plans import all_queries, all_sql
from tidemark.sources import bindings
from tidemark.sources.bindings import Tables
from tidemark.sources.scratch import FORGET_SHUFFLES

NAME, START = "gold_investment_summary", dt.date(1998, 1, 5)
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of few trades: one portfolio with two thirds of them, orders and parts that are not there, parts and portfolios without trades."""
    folder, rng, start = str(tmp_path_factory.mktemp("summary")), random.Random(11), dt.datetime(1997, 12, 20)
    day = lambda n: start + dt.timedelta(days=rng.randrange(n))
    tables = dict(
        region=("r_regionkey int, r_name string", [(0, "NORTH"), (1, "SOUTH")]),
        nation=("n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", i % 2) for i in range(3)]),
        supplier=("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", [(i, f"Supplier {i}", i % 3, i - 2.5) for i in range(6)]),
        part=("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
              [(i, f"part {i}", f"Brand#{i % 4}", ["PROMO X", "LARGE Y", "Z"][i % 3], i * 3, 900.25 + i) for i in range(25)]),
        orders=("o_orderkey bigint, o_orderdate timestamp_ntz", [(i, day(30)) for i in range(90)]),
        lineitem=("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                  "l_tax double, l_returnflag string, l_shipdate timestamp_ntz",
                  [(rng.randrange(90), rng.randrange(28), rng.choice([0, 0, 0, 0, 1, 2, 3]), i, float(rng.randint(1, 50)), rng.randint(100, 10 ** 6) / 100,
                    rng.randint(0, 10) / 100, 0.02, "N", day(30)) for i in range(600)]))
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", [NAME, "gold_security_type_summary"])
@pytest.mark.parametrize("large, broadcast", [(1_000_000, 500_000), (50, 500_000), (0, -1)])
def test_rows_do_not_depend_on_sizes(spark, small, monkeypatch, name, large, broadcast):
    """Portfolios of many lots are summed by day first, and many portfolios are not broadcast; with the same rows."""
    monkeypatch.setattr(bindings, "LARGE", large)
    monkeypatch.setattr(bindings, "SMALL", broadcast)
    folder, con = small
    assert oracle.differences(QUERIES[name](spark, folder), con, SQL[name]) == []


def test_no_row_is_shuffled_after_its_portfolio_day(spark, folder, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = QUERIES[NAME](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joined = re.search(r"SortMergeJoin \[portfolio_id#\w+, as_of_date#\w+\]", text)
    assert "Exchange" not in text[:joined.start()]


def test_written_tables_leave_no_shuffled_files(spark, folder):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}
    there, before = files(), spark.conf.get(FORGET_SHUFFLES)
    Tables(spark, folder).written("lots", Tables(spark, folder).dated_lots)
    assert spark.conf.get(FORGET_SHUFFLES) == before
    until = time.time() + 2
    while (left := files() - there) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_money_that_does_not_fit_stays_wide(spark, folder, monkeypatch):
    much = Decimal("123456789012345678.1234")
    lots = spark.createDataFrame([(1, START, much, Decimal("1.25")), (2, None, None, None)],
                                 "portfolio_id bigint, trade_date date, market_value decimal(28,4), benchmark_value decimal(22,2)")
    monkeypatch.setattr(Tables, "dated_lots", lambda self: lots)
    got = Tables(spark, folder).lots()
    assert dict(got.drop("trade_date").dtypes) == {"portfolio_id": "bigint", "market_value": "decimal(28,4)", "benchmark_value": "decimal(18,2)"}
    assert {tuple(r) for r in got.collect()} == {(1, START, much, Decimal("1.25")), (2, None, None, None)}


def test_packed_texts_come_back(spark):
    odd = [None, "", "a", "\x01", "\x02", "\x02n", "\x02a", "\x02b\x01", "n", "é \x01\x01"]
    rows = [(a, b, c) for a in odd for b in odd for c in (None, "", "z")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    told = df.select(packed(["a", "b", "c"]).alias("_t"), F.lit(1).alias("a"))
    got = told.withColumns(unpacked("_t", ["a", "b", "c"])).select("a", "b", "c").collect()
    assert [tuple(r) for r in got] == rows
