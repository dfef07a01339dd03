"""Sinks of streams that are split by outcome and by event date, and stay right when a batch is repeated.

A row goes to ``out/sink=S/event_date=D/batch_id=N``. All sinks are written by one job, so a micro-batch is computed once. A
batch can only be a repeat when it is the first after a start; what an earlier attempt wrote for it, whatever the dates, is then
deleted first. Late rows add a folder to their own date and touch no other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources import files

PLACE = ["sink", "event_date", "batch_id"]


def dated_sinks(out: str, event_date: Column, sinks: Mapping[str, str], files_per_day: int = 2) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: each row goes to the first of ``sinks`` (name: SQL condition) that holds, else to ``rest``.

    ``files_per_day`` is into how many files the rows of one sink and date are dealt, so that one day is written by several tasks
    and many days don't make a file per task each.
    """
    first = True
    which = F.coalesce(*(F.when(F.expr(condition), name) for name, condition in sinks.items()), F.lit("rest"))

    def store(batch: DataFrame, batch_id: int) -> None:
        nonlocal first
        if first:
            for path in files.matching(batch.sparkSession, f"{out}/sink=*/event_date=*/batch_id={batch_id}"):
                files.remove(batch.sparkSession, path)
            first = False
        placed = batch.withColumns({"sink": which, "event_date": event_date, "batch_id": F.lit(batch_id)})
        dealt = placed.repartition("sink", "event_date", F.pmod(F.xxhash64(*batch.columns), F.lit(files_per_day)))
        dealt.write.mode("append").partitionBy(*PLACE).parquet(out)

    return store


def run_dated(stream: DataFrame, out: str, checkpoint: str, event_date: Column, sinks: Mapping[str, str], files_per_day: int = 2) -> int:
    """Processes all that has arrived and stops. Gives how many rows came later than the watermark allows and were left out."""
    for name in [*sinks, "rest"]:
        files.make_folder(stream.sparkSession, f"{out}/sink={name}")
    query = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(dated_sinks(out, event_date, sinks, files_per_day)).start())
    query.awaitTermination()
    return sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"])


def stored(spark: SparkSession, out: str, sink: str, schema) -> DataFrame:
    """The rows of one sink with event_date and batch_id; a filter on event_date reads those days only."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, event_date date, batch_id bigint").parquet(f"{out}/sink={sink}")
