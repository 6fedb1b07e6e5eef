"""Incremental processing that resumes: by the largest index in the output, or by a streaming checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def resume_point(output: DataFrame, index: str) -> DataFrame:
    """last: the largest index in the output, -1 if it is empty."""
    return output.agg(F.coalesce(F.max(index), F.lit(-1)).cast("long").alias("last"))


def pending_batches(batched: DataFrame, output: DataFrame, index: str, batch: str = "batch") -> DataFrame:
    """batch, n, action of every batch: skip if the output goes beyond it, redo if it ends inside it, else run."""
    spans = batched.groupBy(batch).agg(F.count("*").alias("n"), F.min(index).alias("_first"), F.max(index).alias("_last"))
    joined = spans.join(F.broadcast(resume_point(output, index)))
    action = F.when(F.col("_last") <= F.col("last"), "skip").when(F.col("_first") <= F.col("last"), "redo").otherwise("run")
    return joined.select(batch, "n", action.alias("action"))


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row written of each key. Of copies only the last of each partition is shuffled."""
    newest = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def process_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int = 30) -> int:
    """Runs step over record files that the checkpoint hasn't seen and appends to target; returns batches run.

    The file sink commits each batch once, so a restart neither repeats nor loses records.
    """
    stream = step(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source))
    query = stream.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)
