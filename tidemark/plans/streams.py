"""Streams run over the test tables; each must equal its batch SQL."""

from pyspark.sql import functions as F

from tidemark.plans.monitoring import _cost, _rr, _sum
from tidemark.plans.registry import plain, query
from tidemark.plans.sqlbase import d, using
from tidemark.sources.bindings import Tables
from tidemark.sources import files
from tidemark.sources.scratch import scratch_path
from tidemark.streaming import alerts, dated, jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
OWN = "warehouse_name LIKE 'INV_%'"
SINKS = {"certified": "dq_status = 'CERTIFIED'", "quarantined": "dq_status = 'QUARANTINED'"}


def arriving(t: Tables):
    return Tables.shape_queries(Tables.shape_events(jobs.read_files(t.spark, t.folder, EVENTS, "events.parquet")))


def as_stream(t: Tables, df, label: str):
    """A log table written out and read back as a stream of files."""
    path = scratch_path(t.spark, f"log-{label}")
    df.write.parquet(path)
    return jobs.read_files(t.spark, path, df.schema)


CHECKED = """SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value,
    concat_ws(',', CASE WHEN NOT value < 200 THEN 'value_below_200' END, CASE WHEN NOT CAST(json_extract_string(props, '$.k') AS BIGINT) > 4
      THEN 'k_above_4' END) AS failed_rules,
    CASE WHEN value < 200 AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 4 THEN 'CERTIFIED' ELSE 'QUARANTINED' END AS dq_status FROM events"""


def checked_events(landed):
    rules = {"value_below_200": F.col("value") < 200, "k_above_4": F.col("k") > 4}
    raw = landed.select("event_id", "ts", "value", F.try_parse_json("props").alias("raw_data"))
    return jobs.bronze_to_silver(raw, [("k", "k", "bigint")], rules, ["event_id"], "ts", lag="40 days")


@query("stream_bronze_to_silver", CHECKED)
def _(t):
    """Events by two files in reverse order, so that every day comes late once; the second run goes on where the first stopped."""
    source, out, state = (scratch_path(t.spark, f"silver-{part}") for part in ("events", "table", "state"))
    for even in (0, 1):
        t.raw("events").where(F.col("event_id") % 2 == even).write.mode("append").parquet(f"{source}/part={even}")
        silver = checked_events(jobs.read_files(t.spark, f"{source}/*", EVENTS))
        dated.run_dated(silver, out, state, F.to_date("ts"), SINKS, files_per_day=1)
    good, bad = (dated.stored(t.spark, out, sink, silver.schema) for sink in SINKS)
    return good.unionByName(bad).drop("event_date", "batch_id").withColumn("failed_rules", F.array_join("failed_rules", ","))


@query("stream_quarantine_by_day", f"""WITH c AS ({CHECKED}) SELECT CAST(ts AS DATE) AS event_date, count(*) FILTER (dq_status = 'CERTIFIED') AS certified,
    count(*) FILTER (dq_status = 'QUARANTINED') AS quarantined FROM c WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY 1""")
def _(t):
    """Rows of both sinks by event date, from a run whose batch is repeated, as its commit is lost; only the dates asked for are read."""
    out, state = scratch_path(t.spark, "quarantine-table"), scratch_path(t.spark, "quarantine-state")
    silver = checked_events(jobs.read_files(t.spark, t.folder, EVENTS, "events.parquet"))
    dated.run_dated(silver, out, state, F.to_date("ts"), SINKS, files_per_day=1)
    for log in ("commits", "offsets/1"):
        files.remove(t.spark, f"{state}/{log}")
    dated.run_dated(silver, out, state, F.to_date("ts"), SINKS, files_per_day=1)
    counts = [dated.stored(t.spark, out, sink, silver.schema).where("event_date >= '2024-01-10'").select("event_date", F.lit(sink).alias("sink")) for sink in SINKS]
    return counts[0].unionByName(counts[1]).groupBy("event_date").agg(*(F.count_if(F.col("sink") == sink).alias(sink) for sink in SINKS))


@query("stream_failed_spike", using("qh") + f"""SELECT time_bucket(INTERVAL 15 MINUTE, start_time) AS window_start,
    time_bucket(INTERVAL 15 MINUTE, start_time) + INTERVAL 15 MINUTE AS window_end, count(*) AS failures FROM qh
    WHERE {OWN} AND execution_status = 'FAIL' GROUP BY 1, 2 HAVING count(*) > 2""")
def _(t):
    return jobs.run_once(t.spark, jobs.failed_spike(arriving(t), limit=2), "failed", ["window_start", "window_end"])


@query("stream_long_running", using("qh") + f"""SELECT query_id, user_name, role_name, warehouse_name, start_time, total_elapsed_time
    FROM qh WHERE {OWN} AND total_elapsed_time > 300000""")
def _(t):
    return jobs.run_once(t.spark, jobs.long_running(arriving(t)), "long")


@query("stream_queue_load", using("load", w=f"""SELECT *, time_bucket(INTERVAL 30 MINUTE, start_time) - to_minutes(CAST(30 * i AS INTEGER))
      AS window_start FROM load, range(48) r(i) WHERE {OWN}""") + f"""SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end,
    warehouse_name, count(*) AS sample_count, {_rr('sum(avg_running) * 10000', 'count(*) * 10000', 2, 'avg_queries_running')},
    {_rr('sum(avg_queued_load) * 10000', 'count(*) * 10000', 2, 'avg_queries_queued')},
    {_rr('sum(avg_blocked) * 10000', 'count(*) * 10000', 2, 'avg_queries_blocked')}, {d('ROUND(max(avg_queued_load), 2)', 'peak_queries_queued')}
    FROM w GROUP BY 1, 2, 3""")
def _(t):
    load = as_stream(t, t.warehouse_load(), "load")
    panes = jobs.run_once(t.spark, jobs.queue_panes(load), "queue", ["pane", "warehouse_name"])
    return plain(jobs.queue_windows(panes))


@query("stream_daily_credits", using("metering") + f"""SELECT date_trunc('day', start_time) AS usage_date, warehouse_name,
    {_sum('credits_used', 'total_credits')}, count(*) AS query_count, {_cost('sum(credits_used)')} FROM metering WHERE {OWN} GROUP BY 1, 2""")
def _(t):
    metering = as_stream(t, t.metering(), "metering")
    return plain(jobs.run_once(t.spark, jobs.daily_credits(metering), "credits", ["usage_date", "warehouse_name"]))


# --- alerts with a memory --------------------------------------------------------------------------

def in_two_runs(t, df, label, events):
    """The events of a log of which the second half arrives after a restart."""
    source, out, state = (scratch_path(t.spark, f"{label}-{part}") for part in ("log", "events", "state"))
    for part, own in enumerate((F.col("start_time") < MIDDLE, F.col("start_time") >= MIDDLE)):
        df.where(own).write.parquet(f"{source}/part={part}")
        stream = events(jobs.read_files(t.spark, f"{source}/*", df.schema))
        alerts.with_state_store(lambda: jobs.run_available(stream, out, state, "update"), t.spark)  # noqa: B023
    return jobs.emitted(t.spark, out, stream.schema)


MIDDLE = "2024-01-12 05:10:00"
_CHANGES = """c AS (SELECT *, lag(holds, 1, FALSE) OVER (PARTITION BY subject ORDER BY tick) AS held FROM h)
    SELECT '{name}' AS alert, '{severity}' AS severity, subject, CASE WHEN holds THEN 'started' ELSE 'ended' END AS event, tick AS at FROM c WHERE holds <> held"""
_TICKS = "SELECT unnest(generate_series(min(start_time), max(start_time) - INTERVAL 3 HOUR, INTERVAL 30 MINUTE)) AS tick FROM own"


@query("stream_high_queue_events", using("load", own=f"SELECT *, CAST(avg_queued_load * 10000 AS BIGINT) AS units FROM load WHERE {OWN}", ticks=_TICKS,
    s="""SELECT tick, k.warehouse_name AS subject, CAST(sum(units) AS BIGINT) AS units, count(units) AS n FROM ticks
      CROSS JOIN (SELECT DISTINCT warehouse_name FROM own) k LEFT JOIN own o ON o.warehouse_name = k.warehouse_name
      AND o.start_time >= tick - INTERVAL 24 HOUR AND o.start_time < tick GROUP BY ALL""",
    h="SELECT *, coalesce((units * 200 + n * 10000) // nullif(n * 20000, 0) > 700, FALSE) AS holds FROM s")
    .rstrip() + ",\n" + _CHANGES.format(name="high_queue", severity="WARNING"))
def _(t):
    return in_two_runs(t, t.warehouse_load(), "queue", lambda load: alerts.high_queue(load, limit=7.0))


@query("stream_cost_spike_events", using("metering", own=f"""SELECT start_time - INTERVAL 15 DAY AS start_time, credits_used + credits_used_cloud_services AS credits
      FROM metering WHERE {OWN}""", ticks=_TICKS,
    s="""SELECT tick, 'all clusters' AS subject, sum(CASE WHEN date_trunc('month', start_time) = date_trunc('month', tick) THEN credits END) AS now,
      sum(CASE WHEN date_trunc('month', start_time) = date_trunc('month', tick - INTERVAL 1 MONTH) THEN credits END) AS before
      FROM ticks LEFT JOIN own ON start_time < tick GROUP BY ALL""",
    h="SELECT *, coalesce(now > before * 0.5 AND before > 0, FALSE) AS holds FROM s")
    .rstrip() + ",\n" + _CHANGES.format(name="cost_spike", severity="CRITICAL"))
def _(t):
    """The log set back by 15 days, so that it has two months; half the earlier one is already a spike."""
    earlier = t.metering().withColumn("start_time", F.timestamp_add("DAY", F.lit(-15), "start_time").cast("timestamp_ntz"))
    return in_two_runs(t, earlier, "cost", lambda metering: alerts.cost_spike(metering, factor=0.5))
