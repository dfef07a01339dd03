"""Structured Streaming forms of the log reports and of bronze-to-silver.

Each job is a function from a streaming DataFrame to a streaming DataFrame; the same function gives the
batch result when handed a batch DataFrame. Watermarks default to the lag of the logs: 45 minutes for
queries, 3 hours for clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.clock import instant, wall
from tidemark.functions.measures import rounded_ratio
from tidemark.operators import monitoring, silver
from tidemark.sources.scratch import scratch_path

QUERY_LAG, WAREHOUSE_LAG, PANE = "45 minutes", "3 hours", "30 minutes"
LOAD = ["avg_running", "avg_queued_load", "avg_blocked"]


def read_files(spark: SparkSession, folder: str, schema: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


# --- jobs -----------------------------------------------------------------------------------------

def bronze_to_silver(landed: DataFrame, fields: Sequence[tuple[str, str, str]], rules: Mapping[str, Column], key: Sequence[str],
                     event_time: str, lag: str = QUERY_LAG) -> DataFrame:
    """Parsed and checked records, one per key among those that arrive within ``lag`` of each other.

    The key set is forgotten once the watermark passes, so state stays bounded.
    """
    parsed = silver.parse_variant(landed, fields)
    seen = parsed.withColumn("_at", instant(event_time)).withWatermark("_at", lag)
    unique = seen.dropDuplicatesWithinWatermark(list(key)) if landed.isStreaming else seen.dropDuplicates(list(key))
    return silver.validate(unique.drop("_at"), rules)


def failed_spike(queries: DataFrame, limit: int = 10, window: str = "15 minutes", lag: str = QUERY_LAG) -> DataFrame:
    """Windows with more than ``limit`` failed queries."""
    failures = queries.where((F.col("execution_status") == "FAIL") & F.col("warehouse_name").like("INV_%"))
    timed = failures.select(instant("start_time").alias("_at")).withWatermark("_at", lag)
    return (timed.groupBy(F.window("_at", window)).agg(F.count("*").alias("failures")).where(F.col("failures") > limit)
            .select(wall("window.start").alias("window_start"), wall("window.end").alias("window_end"), "failures"))


def long_running(queries: DataFrame, limit_ms: int = 300_000) -> DataFrame:
    """Long queries as they arrive; no state."""
    return queries.where(F.col("warehouse_name").like("INV_%") & (F.col("total_elapsed_time") > limit_ms)).select(
        "query_id", "user_name", "role_name", "warehouse_name", "start_time", "total_elapsed_time")


def queue_panes(load: DataFrame, every: str = PANE, lag: str = WAREHOUSE_LAG) -> DataFrame:
    """Sums, counts and peak of each half hour and cluster: a sample enters one state row, and only panes within ``lag`` stay in the state."""
    own = load.where(F.col("warehouse_name").like("INV_%")).withColumn("_at", instant("start_time")).withWatermark("_at", lag)
    return own.groupBy(F.window("_at", every), "warehouse_name").agg(
        F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in LOAD for name, f in (("sum", F.sum), ("known", F.count))),
        F.max("avg_queued_load").alias("peak")).select(wall("window.start").alias("pane"), "warehouse_name", "n",
                                                       *(f"{name}_{c}" for c in LOAD for name in ("sum", "known")), "peak")


def queue_windows(panes: DataFrame, merged: int = 48) -> DataFrame:
    """Load of the last 24 hours per cluster, as it stood every 30 minutes: ``merged`` panes a window, summed before the shuffle."""
    half_hours = lambda k: F.timestamp_add("MINUTE", F.lit(30) * k, "pane").cast("timestamp_ntz")
    placed = panes.withColumn("_k", F.explode(F.sequence(F.lit(1 - merged), F.lit(0)))).withColumn("window_start", half_hours(F.col("_k")))
    mean = lambda c: rounded_ratio(F.sum(f"sum_{c}") * 10000, F.sum(f"known_{c}") * 10000, 2)
    return (placed.groupBy("window_start", "warehouse_name").agg(
        F.sum("n").alias("sample_count"), mean("avg_running").alias("avg_queries_running"), mean("avg_queued_load").alias("avg_queries_queued"),
        mean("avg_blocked").alias("avg_queries_blocked"), F.round(F.max("peak"), 2).alias("peak_queries_queued"))
        .withColumn("window_end", F.timestamp_add("MINUTE", F.lit(30 * merged), "window_start").cast("timestamp_ntz"))
        .select("window_start", "window_end", "warehouse_name", "sample_count", "avg_queries_running", "avg_queries_queued", "avg_queries_blocked", "peak_queries_queued"))


def daily_credits(metering: DataFrame, lag: str = WAREHOUSE_LAG) -> DataFrame:
    """Running credits per day and cluster."""
    own = metering.where(F.col("warehouse_name").like("INV_%")).withColumn("_at", instant("start_time")).withWatermark("_at", lag)
    return own.groupBy(F.window("_at", "1 day"), "warehouse_name").agg(
        F.sum("credits_used").alias("total_credits"), F.count("*").alias("query_count"),
        F.round(F.sum("credits_used") * monitoring.PRICE_PER_CREDIT, 2).alias("estimated_cost_usd")).select(
        wall("window.start").alias("usage_date"), "warehouse_name", "total_credits", "query_count", "estimated_cost_usd")


# --- running --------------------------------------------------------------------------------------

def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that has arrived and stops. Each micro-batch owns one folder, which a repeated
    batch overwrites, so the result is the same after a failure."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .foreachBatch(store).start().awaitTermination())


def latest(spark: SparkSession, out: str, schema, keys: Sequence[str]) -> DataFrame:
    """Last emitted row per key of a stream run in update mode."""
    emitted = _stored(spark, out, schema)
    rest = [c for c in emitted.columns if c not in (*keys, "batch_id")]
    last = emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def emitted(spark: SparkSession, out: str, schema) -> DataFrame:
    """All rows of a stream's run."""
    return _stored(spark, out, schema).drop("batch_id")


def _stored(spark: SparkSession, out: str, schema) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch_id=-1")
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def run_once(spark: SparkSession, stream: DataFrame, label: str, keys: Sequence[str] | None = None,
             finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs a stream over what is there and returns its result: all rows, or the last row per ``keys``."""
    out, checkpoint = scratch_path(spark, f"stream-{label}"), scratch_path(spark, f"stream-{label}-state")
    run_available(stream, out, checkpoint, "update" if keys else "append")
    rows = latest(spark, out, stream.schema, keys) if keys else _stored(spark, out, stream.schema).drop("batch_id")
    return finish(rows)
