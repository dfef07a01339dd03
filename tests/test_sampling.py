"""Samples: the same rows however the table is cut, nested shares, groups cut before the shuffle."""

from pyspark.sql import functions as F

from tidemark.operators import sampling

ROWS = 20_000


def made(spark):
    return spark.range(ROWS).select(F.col("id"), (F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("g"), (F.col("id") * 2).alias("v"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_shares_are_nested_and_near_what_was_asked(spark):
    df = made(spark)
    found = {share: set(ids(sampling.bernoulli(df, ["id"], share, "x"))) for share in (0.0, 0.05, 0.1, 0.5, 1.0)}
    assert not found[0.0] and len(found[1.0]) == ROWS
    assert found[0.05] < found[0.1] < found[0.5]
    for share in (0.05, 0.1, 0.5):
        assert abs(len(found[share]) - share * ROWS) < 5 * (share * (1 - share) * ROWS) ** 0.5
    other = set(ids(sampling.bernoulli(df, ["id"], 0.1, "y")))
    assert abs(len(other & found[0.1]) - 0.01 * ROWS) < 80
    assert ids(sampling.bernoulli(df.repartition(7, "v"), ["id"], 0.1, "x")) == sorted(found[0.1])


def test_random_order_is_the_same_in_any_cut(spark):
    df = made(spark)
    first = [tuple(r) for r in sampling.random_order(df, ["id"], 50, "s").orderBy("place").collect()]
    again = [tuple(r) for r in sampling.random_order(df.repartition(9, "v"), ["id"], 50, "s").orderBy("place").collect()]
    assert first == again and [r[-1] for r in first] == list(range(1, 51)) and len({r[0] for r in first}) == 50
    assert [r[0] for r in first] != sorted(r[0] for r in first)
    assert [r[0] for r in sampling.random_order(df, ["id"], 20, "s").orderBy("place").collect()] == [r[0] for r in first[:20]]
    assert "TakeOrderedAndProject" in sampling.random_order(df, ["id"], 50)._jdf.queryExecution().executedPlan().toString()
    assert sampling.random_order(df.limit(3), ["id"], 50).count() == 3 and sampling.random_order(df.limit(0), ["id"], 5).count() == 0


def test_groups(spark):
    df = made(spark)
    drawn = sampling.random_per_group(df, ["g"], ["id"], 7)
    assert "WindowGroupLimit" in drawn._jdf.queryExecution().executedPlan().toString()
    counts = {r["g"]: r["count"] for r in drawn.groupBy("g").count().collect()}
    assert len(counts) == 50 and set(counts.values()) == {7}
    assert ids(drawn) == ids(sampling.random_per_group(df.repartition(5, "v"), ["g"], ["id"], 7))


def test_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, 2), (5, 3), (5, 3)], "id int, v int")
    for share in (0.3, 0.6, 0.9):
        found = [r["id"] for r in sampling.bernoulli(df, ["id"], share).collect()]
        assert found.count(None) in (0, 3) and found.count(5) in (0, 2)
    assert [r["place"] for r in sampling.random_order(df, ["id"], 4).orderBy("place").collect()] == [1, 2, 3, 4]
