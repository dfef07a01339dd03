"""Folders for tables a job writes on its way: always below the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: has Spark delete what an execution shuffled when it ends
FORGET_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def forgetting_shuffles(spark: SparkSession) -> Iterator[None]:
    """What the actions in here shuffle goes as soon as each of them ends."""
    before = spark.conf.get(FORGET_SHUFFLES)
    spark.conf.set(FORGET_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FORGET_SHUFFLES, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"
