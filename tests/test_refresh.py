"""Incremental refresh against full runs, and tables whose partitions are replaced at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, refresh
from tidemark.sources import versions

D0 = dt.date(2024, 1, 1)
SCHEMA = "security_id string, trade_date date, close_price double"


def series(seed, n=90):
    rng = random.Random(seed)
    return {(s, D0 + dt.timedelta(days=i)): rng.randint(1, 99) / 4 for s in ("A", "B", "C") for i in range(n) if rng.random() < 0.8}


def frame(spark, bars):
    return spark.createDataFrame([(*k, v) for k, v in bars.items()], SCHEMA)


def compute(df):
    return features.sma(features.returns(df), spans=(3, 10))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("security_id", "trade_date", "close_price", "daily_return", "sma_3", "sma_10").collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_full_run(spark, seed):
    """Late rows, other prices, withdrawn rows, an entity that appears and one that is gone."""
    rng = random.Random(seed)
    before = series(seed)
    after = dict(before)
    changed = rng.sample(sorted(before), 4)
    for key in changed[:2]:
        after[key] = 77.0
    for key in changed[2:]:
        del after[key]
    new = [("A", D0 + dt.timedelta(days=45, hours=0)), ("D", D0), ("C", D0 + dt.timedelta(days=500))]
    after.update({k: 5.0 for k in new})
    marks = spark.createDataFrame([*changed, *new], "security_id string, trade_date date")
    bars = frame(spark, after)
    fresh = refresh.renewed(bars, marks, compute, "security_id", "trade_date", 10)
    merged = refresh.merged(compute(frame(spark, before)), fresh, marks, ["security_id", "trade_date"])
    assert rows_of(merged) == rows_of(compute(bars))
    stale = {(r["security_id"], r["trade_date"]) for r in fresh.collect()}
    touched = {s for s, _ in [*changed, *new]}
    assert {s for s, _ in stale} <= touched and len(stale) <= 10 * len(changed + new)


def test_reads_no_more_than_the_halo(spark):
    bars = {("A", D0 + dt.timedelta(days=i)): 1.0 * i + 1 for i in range(100)} | {("B", D0): 1.0}
    marks = spark.createDataFrame([("A", D0 + dt.timedelta(days=50)), ("A", None)], "security_id string, trade_date date").where("trade_date is not null")
    found = refresh.halo(frame(spark, bars), marks, "security_id", "trade_date", 10).collect()
    days = sorted((r["trade_date"] - D0).days for r in found)
    assert days == list(range(41, 60)) and sorted((r["trade_date"] - D0).days for r in found if r[refresh.STALE]) == list(range(50, 60))
    nothing = refresh.renewed(frame(spark, bars), marks.where("false"), compute, "security_id", "trade_date", 10)
    assert nothing.count() == 0


def test_versions_replace_partitions_at_once(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id int, month string"

    def put(rows, touched=None):
        df = spark.createDataFrame(rows, schema)
        return versions.publish(df, path, "month", touched and spark.createDataFrame([(t,) for t in touched], "part string"))

    def now(where="true"):
        return sorted((r["id"], r["month"]) for r in versions.current(spark, path, spark.createDataFrame([], schema).schema).where(where).collect())

    assert put([(1, "a"), (2, "b"), (3, "c")]) == 1
    assert put([(4, "b")]) == 2 and now() == [(1, "a"), (3, "c"), (4, "b")]
    assert put([], ["c"]) == 3 and now() == [(1, "a"), (4, "b")]
    # a publication that breaks off before its list of partitions is not seen, and the next one starts afresh
    spark.createDataFrame([(9, "a", "a")], "id int, month string, part string").write.partitionBy("part").parquet(f"{path}/rows/version=4")
    assert now() == [(1, "a"), (4, "b")]
    table = versions.current(spark, path, spark.createDataFrame([], schema).schema).drop("part")
    assert versions.publish(table.where("month = 'b'").withColumn("id", F.col("id") + 1), path, "month") == 4
    assert now() == [(1, "a"), (5, "b")] and now("part = 'b'") == [(5, "b")]
