"""Running a stream over everything that has arrived, into tables that survive a restart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import q


def read_stream(spark: SparkSession, folder: str, file_glob: str | None = None, schema=None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder."""
    if schema is None:
        probe = spark.read
        if file_glob:
            probe = probe.option("pathGlobFilter", file_glob)
        schema = probe.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the stream emits to a parquet table, exactly once, and return when caught up."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def update_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write the rows each batch changed under ``batch=<id>``. A repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The current row per key of a table written by :func:`update_table`."""
    w = Window.partitionBy(*[q(k) for k in keys]).orderBy(F.desc("batch"))
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "batch")


def stream_moments(stream: DataFrame, features, path: str, checkpoint: str) -> None:
    """Append one table of moments per batch; :func:`stored_moments` adds them up."""
    from ..operators.reduce import moments

    def write(batch: DataFrame, batch_id: int) -> None:
        moments(batch, features).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stored_moments(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.reduce import merge_moments

    return merge_moments(spark.read.option("basePath", path).parquet(path).drop("batch"))
