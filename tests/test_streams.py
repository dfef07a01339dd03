"""Streams over several files: duplicates, late rows, restarts."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import dated, jobs

T0 = dt.datetime(2024, 1, 10, 12, 0)
SCHEMA = "id bigint, at timestamp_ntz, doc string"


def drop_file(spark, path, name, rows, schema=SCHEMA):
    """One parquet file per call, so each is one micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").option("compression", "none").parquet(f"{path}/{name}")


def stream(spark, path, schema=SCHEMA):
    return jobs.read_files(spark, f"{path}/*", schema, files_per_batch=1)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def test_duplicates_across_batches_and_bad_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    drop_file(spark, src, "a", [(1, minutes(0), '{"px": 5}'), (1, minutes(0), '{"px": 5}'), (2, minutes(1), '{"px": -1}')])

    def run():
        landed = stream(spark, src).select("id", "at", F.try_parse_json("doc").alias("raw_data"))
        job = jobs.bronze_to_silver(landed, [("px", "px", "int")], {"positive": F.col("px") > 0}, ["id"], "at")
        jobs.run_available(job, out, state)
        return sorted((r.id, r.px, r.dq_status) for r in spark.read.parquet(out).collect())

    first = run()
    assert first == [(1, 5, "CERTIFIED"), (2, -1, "QUARANTINED")]
    assert run() == first
    drop_file(spark, src, "b", [(1, minutes(2), '{"px": 5}'), (3, minutes(3), "not json")])
    assert run() == first + [(3, None, "QUARANTINED")]


def failures(spark, path):
    return stream(spark, path, "start_time timestamp_ntz").select(
        "start_time", F.lit("FAIL").alias("execution_status"), F.lit("INV_ML_WH").alias("warehouse_name"))


def test_window_counts_follow_late_rows_within_the_watermark(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    keys = ["window_start", "window_end"]

    def run():
        job = jobs.failed_spike(failures(spark, src), limit=10)
        jobs.run_available(job, out, state, "update")
        return {r.window_start: r.failures for r in jobs.latest(spark, out, job.schema, keys).collect()}

    drop_file(spark, src, "a", [(minutes(1),)] * 10 + [(minutes(16),)] * 11, "start_time timestamp_ntz")
    assert run() == {minutes(15): 11}
    drop_file(spark, src, "b", [(minutes(2),)], "start_time timestamp_ntz")
    assert run() == {minutes(0): 11, minutes(15): 11}
    drop_file(spark, src, "c", [(minutes(600),)], "start_time timestamp_ntz")
    run()
    drop_file(spark, src, "d", [(minutes(3),)], "start_time timestamp_ntz")
    assert run() == {minutes(0): 11, minutes(15): 11}


def test_batch_and_stream_forms_agree(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "warehouse_name string, start_time timestamp_ntz, credits_used decimal(10,3)"
    rows = [(w, minutes(60 * h), None) for h in range(40) for w in ("INV_A", "INV_B", "OTHER")]
    drop_file(spark, src, "a", rows[:70], schema)
    drop_file(spark, src, "b", rows[70:], schema)
    fill = F.lit(1.5).cast("decimal(10,3)")
    job = jobs.daily_credits(stream(spark, src, schema).withColumn("credits_used", fill))
    jobs.run_available(job, out, state, "update")
    batch = jobs.daily_credits(spark.createDataFrame(rows, schema).withColumn("credits_used", fill))
    keys = ["usage_date", "warehouse_name"]
    got = jobs.latest(spark, out, job.schema, keys)
    assert sorted(map(tuple, got.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert got.count() == 6


def day(n, hour=9):
    return dt.datetime(2024, 1, 1 + n, hour)


SINKS = {"certified": "dq_status = 'CERTIFIED'", "quarantined": "dq_status = 'QUARANTINED'"}


def silver_job(spark, src):
    landed = stream(spark, src).select("id", "at", F.try_parse_json("doc").alias("raw_data"))
    return jobs.bronze_to_silver(landed, [("px", "px", "int")], {"positive": F.col("px") > 0}, ["id"], "at", lag="5 days")


def folders(out):
    """Every data file by its folder."""
    found = {}
    for top, _, names in os.walk(out):
        data = sorted(n for n in names if n.endswith(".parquet"))
        if data:
            found[os.path.relpath(top, out)] = data
    return found


def test_dated_sinks_across_restarts_late_days_and_repeats(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))

    def run():
        job = silver_job(spark, src)
        dropped = dated.run_dated(job, out, state, F.to_date("at"), SINKS)
        rows = {s: sorted((r.id, r.px) for r in dated.stored(spark, out, s, job.schema).collect()) for s in SINKS}
        return dropped, rows

    drop_file(spark, src, "a", [(1, day(0), '{"px": 5}'), (2, day(1), '{"px": -1}'), (3, day(1), '{"px": 7}')])
    assert run() == (0, {"certified": [(1, 5), (3, 7)], "quarantined": [(2, -1)]})
    before = folders(out)
    assert set(before) == {"sink=certified/event_date=2024-01-01/batch_id=0", "sink=certified/event_date=2024-01-02/batch_id=0",
                           "sink=quarantined/event_date=2024-01-02/batch_id=0"}
    # a restart, a row of an early day, a duplicate and a new day: only new folders of their own dates
    drop_file(spark, src, "b", [(4, day(0), '{"px": 2}'), (1, day(0), '{"px": 5}'), (5, day(3), "no json")])
    assert run() == (0, {"certified": [(1, 5), (3, 7), (4, 2)], "quarantined": [(2, -1), (5, None)]})
    after = folders(out)
    added = {f for f in after if f not in before}
    assert {f: n for f, n in after.items() if f in before} == before and {f.split("/")[1] for f in added} == {"event_date=2024-01-01", "event_date=2024-01-04"}
    assert len({f.split("/")[2] for f in added}) == 1
    # the last batch is repeated: the run ended after its rows were written, and a stray folder of a half-done attempt is left
    last = max(int(f.rpartition("=")[2]) for f in added)
    for log, least in (("commits", last), ("offsets", last + 1)):
        for name in os.listdir(f"{state}/{log}"):
            if name.isdigit() and int(name) >= least:
                files.remove(spark, f"{state}/{log}/{name}")
    spark.createDataFrame([(99, day(8), "CERTIFIED")], "id bigint, at timestamp_ntz, dq_status string").write.parquet(
        f"{out}/sink=certified/event_date=2024-01-09/batch_id={last}")
    assert run()[1] == {"certified": [(1, 5), (3, 7), (4, 2)], "quarantined": [(2, -1), (5, None)]}
    again = folders(out)
    assert {f: n for f, n in again.items() if f in before} == before and set(again) == set(after)
    assert all(again[f] != after[f] for f in added)


def test_rows_beyond_the_watermark_are_counted(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for name, n in (("a", 0), ("b", 20), ("c", 21)):
        drop_file(spark, src, name, [(n, day(n), '{"px": 5}')])
        job = silver_job(spark, src)
        dated.run_dated(job, out, state, F.to_date("at"), SINKS)
    drop_file(spark, src, "d", [(77, day(1), '{"px": 5}'), (78, None, '{"px": 5}')])
    assert dated.run_dated(silver_job(spark, src), out, state, F.to_date("at"), SINKS) >= 1
    assert 77 not in {r.id for r in dated.stored(spark, out, "certified", job.schema).collect()}


def test_panes_merge_to_sliding_windows(spark, tmp_path):
    """Panes that are renewed by late samples give the load of every 24 hours; a sample is one state row, not 48."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "warehouse_name string, start_time timestamp_ntz, avg_running decimal(18,4), avg_queued_load decimal(18,4), avg_blocked decimal(18,4)"
    value = lambda x: None if x is None else Decimal(x)
    rows = [(w, minutes(20 * i), value(i), value(i % 5), value(None if i % 3 else 1)) for i in range(150) for w in ("INV_A", "INV_B", "OTHER") if i % 7 or w == "INV_B"]
    parts = [rows[:100] + rows[110:120], rows[100:110] + rows[120:300], rows[300:]]
    states = []
    for i, part in enumerate(parts):
        drop_file(spark, src, f"f{i}", part, schema)
        job = jobs.queue_panes(stream(spark, src, schema))
        query = (job.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
                 .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch_id={n}")).start())
        query.awaitTermination()
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
    found = jobs.queue_windows(jobs.latest(spark, out, job.schema, ["pane", "warehouse_name"]))
    expected = {}
    for w, at, running, queued, blocked in rows:
        if w != "OTHER":
            pane = at.replace(minute=at.minute // 30 * 30)
            for k in range(48):
                expected.setdefault((pane - dt.timedelta(minutes=30 * k), w), []).append((running, queued, blocked))
    got = {(r["window_start"], r["warehouse_name"]): r for r in found.collect()}
    assert set(got) == set(expected)
    for key, own in expected.items():
        mean = lambda i: next(iter([float(sum(v)) / len(v) for v in [[x[i] for x in own if x[i] is not None]] if v]), None)  # noqa: E731, B023
        r = got[key]
        assert r["sample_count"] == len(own) and r["window_end"] - r["window_start"] == dt.timedelta(days=1)
        assert [r["avg_queries_running"], r["avg_queries_queued"]] == pytest.approx([mean(0), mean(1)], abs=0.00501)
        assert r["peak_queries_queued"] == max(x[1] for x in own)
    assert max(states) <= 2 * (8 + 70)  # panes of both clusters within the lag and of one batch
