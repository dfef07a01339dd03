"""Tables written on the way, and small helpers for Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.sources.scratch import scratch_path


#: has Spark delete what an execution shuffled when it ends
FORGET_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back, so that what it holds is fixed and its lineage ends.

    What was shuffled for it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(FORGET_SHUFFLES)
    spark.conf.set(FORGET_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FORGET_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._kept_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``kept`` wrote for tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def each(column):
    """The values of an Arrow column one by one, so that a batch of long texts is not held twice."""
    return (x.as_py() for x in column)


def with_columns(batch, columns: dict):
    """An Arrow batch with more columns."""
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in columns.values())], [*batch.schema.names, *columns])


def schema_of(df: DataFrame, *more: str) -> str:
    """The columns of ``df`` and more, as text."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def set_aside(df: DataFrame, used: list[str], added: list[str]):
    """``df`` with its columns other than ``used`` under names that clash with nothing, and the function that undoes it.

    Columns named like one of ``added`` are dropped: the operator's replace them.
    """
    lowered = {c.lower() for c in added}
    columns = [c for c in df.columns if c.lower() not in lowered]
    names = {c: c if c in used else f"__aside_{i}" for i, c in enumerate(columns)}
    renamed = df.select(*(df[f"`{c}`"].alias(names[c]) for c in columns))

    def restore(result: DataFrame) -> DataFrame:
        return result.select(*(result[names[c]].alias(c) for c in columns), *added)
    return renamed, restore
