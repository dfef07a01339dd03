"""Session settings the library is designed for; a cluster may set its own instead."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **overrides: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # hot join keys are cut into several tasks at run time
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a side is broadcast only when its measured size is below this; otherwise it is shuffled
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(overrides)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
