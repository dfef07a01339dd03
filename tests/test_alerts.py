"""Alerts with a memory against the batch conditions replayed every half hour, with restarts and late samples in between."""

import datetime as dt
import random
from decimal import Decimal

from tidemark.operators import alerts as batch
from tidemark.streaming import alerts, jobs

T0 = dt.datetime(2024, 1, 10)
LOAD = "warehouse_name string, start_time timestamp_ntz, avg_queued_load decimal(18,4), avg_running decimal(18,4), avg_blocked decimal(18,4), end_time timestamp_ntz"
METER = "warehouse_name string, start_time timestamp_ntz, credits_used decimal(20,3), credits_used_cloud_services decimal(20,3)"
HALF = dt.timedelta(minutes=30)


def streamed(spark, tmp_path, parts, schema, job):
    """Runs the job once for each part of the log."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{i}")
        stream = job(jobs.read_files(spark, f"{src}/*", schema))
        alerts.with_state_store(lambda: jobs.run_available(stream, out, state, "update"), spark)  # noqa: B023
    return sorted((r["subject"], r["at"], r["event"]) for r in jobs.emitted(spark, out, stream.schema).collect())


def changes(subject, ticks, holds):
    out, was = [], False
    for tick in ticks:
        if holds(tick) != was:
            was = not was
            out.append((subject, tick, "started" if was else "ended"))
    return out


def test_queue_events_equal_the_condition_polled(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for name in ("INV_A_WH", "INV_B_WH", "OTHER"):
        for hour in range(120):
            if name == "INV_B_WH" and 30 < hour < 70:
                continue  # a gap of more than a day ends the alert
            at = T0 + dt.timedelta(hours=hour, minutes=rng.choice([0, 0, 10, 29, 45]))
            value = Decimal(rng.randint(0, 40_000) + (60_000 if 20 < hour < 60 else 0)) / 10_000
            rows.append((name, at, value, value, Decimal(0), at + HALF))
    rows.sort(key=lambda r: r[1])
    late = rows[50:60]  # within the lag: they come with the samples after them
    parts = [rows[:50] + rows[60:62], late + rows[62:200], [(None, None, None, None, None, None)] + rows[200:]]
    end = max(r[1] for r in rows if r[0] != "OTHER") - dt.timedelta(hours=3)
    found = streamed(spark, tmp_path, parts, LOAD, lambda df: alerts.high_queue(df, limit=5.0))
    expected = []
    for name in ("INV_A_WH", "INV_B_WH"):
        own = [(r[1], r[2]) for r in rows if r[0] == name]

        def holds(tick):
            values = [v for at, v in own if tick - dt.timedelta(hours=24) <= at < tick]  # noqa: B023
            return bool(values) and round(float(sum(values)) / len(values) * 100 + 1e-9) > 500
        ticks = [T0 + HALF * i for i in range(400) if T0 + HALF * i <= end]
        expected += changes(name, ticks, holds)
    assert found == sorted(expected) and {e for _, _, e in found} == {"started", "ended"}
    # the batch alert, read at the moments around the events
    log = spark.createDataFrame(rows, LOAD)
    for subject, at, event in found[:3]:
        own = log.where((log.warehouse_name == subject) & (log.start_time < at))
        assert batch.high_queue(own, at).first()["fired"] == (event == "started")
        before = at - HALF
        assert batch.high_queue(log.where((log.warehouse_name == subject) & (log.start_time < before)), before).first()["fired"] == (event == "ended")


def test_cost_events_equal_the_condition_polled(spark, tmp_path):
    start = dt.datetime(2023, 11, 20)
    rows = [("INV_A_WH", start + dt.timedelta(hours=6 * i), Decimal(i % 7 + (40 if 45 < i < 60 else 0)), Decimal("0.125")) for i in range(4 * 75)]
    rows += [("INV_B_WH", r[1], None, Decimal("0.5")) for r in rows[::5]] + [("OTHER", rows[3][1], Decimal(10_000), None)]
    rows.sort(key=lambda r: r[1])
    found = streamed(spark, tmp_path, [rows[:100], rows[100:101], rows[101:]], METER, lambda df: alerts.cost_spike(df, factor=1.2))
    end = rows[-1][1] - dt.timedelta(hours=3)
    own = [(r[1], (r[2] or 0) + (r[3] or 0)) for r in rows if r[0] != "OTHER"]

    def holds(tick):
        first = tick.replace(day=1, hour=0, minute=0)
        last = (first - dt.timedelta(days=1)).replace(day=1)
        now, before = sum(v for at, v in own if first <= at < tick), sum(v for at, v in own if last <= at < first)
        return before > 0 and now > before * Decimal("1.2")
    ticks = [start + HALF * i for i in range(48 * 80) if start + HALF * i <= end]
    assert found == changes("all clusters", ticks, holds) and len(found) >= 2
    log = spark.createDataFrame(rows, METER)
    for _, at, event in found[:2]:
        assert batch.cost_spike(log.where(log.start_time < at), at).first()["fired"] == (event == "started")
