"""As-of joins on instants against a plain search."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof

T0 = dt.datetime(2024, 1, 10)
FACTS, VALUES = "k string, at timestamp_ntz, id int, note string", "k string, at timestamp_ntz, rate double, source string"


def made(seed, n, values):
    rng = random.Random(seed)
    at = lambda: rng.choice([None, *(T0 + dt.timedelta(minutes=rng.randint(0, 6000)) for _ in range(12))])
    if values:
        return [(rng.choice(["a", "a", "b", None]), at(), rng.choice([None, 1.0, 2.0, 3.5]), rng.choice(["x", "y"])) for _ in range(n)]
    return [(rng.choice(["a", "a", "a", "b", "c", None]), at(), i, "n") for i in range(n)]


def plain(facts, values):
    out = []
    for k, at, i, note in facts:
        own = [v for v in values if v[0] == k and k is not None and at is not None and v[1] is not None and v[1] <= at]
        low = lambda v: (v[1], (v[2] is not None, v[2] or 0), v[3])
        best = max(own, key=low) if own else (None,) * 4
        out.append((k, at, i, note, best[2], best[3]))
    return sorted(out, key=lambda r: r[2])


@pytest.mark.parametrize("part", [None, "hour", "all"])
def test_equals_a_plain_search(spark, part):
    part_of = None if part is None else F.hour("at") + 24 * F.dayofyear("at") if part == "hour" else F.lit(0)
    facts, values = made(1, 300, False), made(2, 60, True)
    found = asof.last_known(spark.createDataFrame(facts, FACTS), spark.createDataFrame(values, VALUES), ["k"], "at", ["rate", "source"], part_of)
    assert found.columns == ["k", "at", "id", "note", "rate", "source"]
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[2]) == plain(facts, values)


def test_empty_sides_and_repeated_facts(spark):
    facts, none = spark.createDataFrame([("a", T0, 1, "n")] * 3, FACTS), spark.createDataFrame([], VALUES)
    assert [tuple(r)[2:] for r in asof.last_known(facts, none, ["k"], "at", ["rate"]).collect()] == [(1, "n", None)] * 3
    assert asof.last_known(facts.limit(0), none, ["k"], "at", ["rate"]).collect() == []
    one = spark.createDataFrame([("a", T0, 2.0, "x")], VALUES)
    assert {r["rate"] for r in asof.last_known(facts, one, ["k"], "at", ["rate"]).collect()} == {2.0}


def test_a_hot_key_is_dealt_out_by_slice(spark):
    facts = spark.createDataFrame(made(1, 50, False), FACTS)
    plan = asof.last_known(facts, spark.createDataFrame(made(2, 9, True), VALUES), ["k"], "at", ["rate"])._jdf.queryExecution().executedPlan().toString()
    assert "Window [last(_value" in plan and "[k#" in plan
    final = plan[plan.index("Window [last(_value"):]
    assert "_part#" in final.split("\n")[0]
