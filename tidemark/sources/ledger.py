"""Landing that can be repeated: a ledger of the files whose rows a bronze table holds.

``table/rows/landing=N/load_date=D`` holds the rows that the Nth landing read, ``table/ledger/landing=N`` the files it read
them from. A file's newest entry is the one that counts, so rows of older landings of the same file are not seen
any more, and rows are seen only once their entry is written: a landing that breaks off leaves nothing behind that a reader sees, and
the next one takes its number. One landing runs at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import files

ENTRY = "source_file string, path string, length bigint, modified timestamp"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(source_file, path, length, modified) of the files of a folder and those below it; no file is opened."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder))
    return found.select(F.col("_metadata.file_path").alias("source_file"), "path", "length", F.col("modificationTime").alias("modified"))


def entries(spark: SparkSession, table: str) -> DataFrame:
    """The newest entry of each file ever landed, with its landing; ``length`` is null where the file is gone."""
    schema = f"{ENTRY}, landing int"
    if not files.exists(spark, f"{table}/ledger"):
        return spark.createDataFrame([], schema)
    every = spark.read.schema(schema).parquet(f"{table}/ledger")
    newest = F.max_by(F.struct("path", "length", "modified", "landing"), "landing").alias("_e")
    return every.groupBy("source_file").agg(newest).select("source_file", "_e.*")


def land(spark: SparkSession, folder: str, table: str, read: Callable[[list[str]], DataFrame], *, pattern: str = "*", mirror: bool = False) -> int:
    """Lands the files that are new or changed (other length or time) since the last landing and gives their number.

    ``read`` turns paths into rows with ``source_file`` and ``load_timestamp``. With ``mirror`` the rows of files that are gone
    from the folder go as well; else they stay. Only the paths of new files come to the driver, which any read by path needs.
    """
    present, known = listing(spark, folder, pattern), entries(spark, table)
    live = known.where("length IS NOT NULL")
    fresh = present.join(live, ["source_file", "length", "modified"], "left_anti").select("source_file", "path", "length", "modified")
    gone = live.join(present, "source_file", "left_anti").select(
        "source_file", "path", F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    new = fresh.collect()
    lost = gone.collect() if mirror else []
    if not new and not lost:
        return 0
    number = (known.agg(F.max("landing")).first()[0] or 0) + 1
    rows, ledger = f"{table}/rows/landing={number}", f"{table}/ledger/landing={number}"
    if new:
        landed = read([r["path"] for r in new]).withColumn("load_date", F.to_date("load_timestamp"))
        landed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("load_date").parquet(rows)
    spark.createDataFrame(new + lost, ENTRY).coalesce(1).write.mode("overwrite").parquet(ledger)
    return len(new)


def bronze(spark: SparkSession, table: str) -> DataFrame:
    """The rows that count, with load_date and landing, both of which prune folders when filtered on."""
    rows = spark.read.parquet(f"{table}/rows")
    live = entries(spark, table).where("length IS NOT NULL").select("source_file", "landing")
    return rows.join(live, ["source_file", "landing"], "left_semi").select(rows.columns)


def vacuum(spark: SparkSession, table: str) -> int:
    """Deletes the rows of landings of which no file counts any more, and of landings that broke off; gives how many."""
    live = {r["landing"] for r in entries(spark, table).where("length IS NOT NULL").select("landing").distinct().collect()}
    dead = [p for p in files.matching(spark, f"{table}/rows/landing=*") if int(p.rpartition("=")[2]) not in live]
    for path in dead:
        files.remove(spark, path)
    return len(dead)
