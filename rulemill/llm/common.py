"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from rulemill.sources.tables import importable, remove, run_dir

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and keeps Arrow batches small enough for long texts.

    Batches are read when a plan runs, after this returns, so the setting stays; one that the caller has changed isn't
    touched.
    """
    importable(spark)
    if spark.conf.get(_BATCH_ROWS) == "10000":  # Spark's own default
        spark.conf.set(_BATCH_ROWS, "2000")
    return spark


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving Arrow's unused memory back at its end.

    Python workers wait for the next stage, and what they hold adds to the executor's memory meanwhile.
    """

    def outer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return outer


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this session wrote on the way. Results not yet written elsewhere can't be read any more."""
    remove(spark, run_dir(spark))


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of executors.

    The copy stays until `clear`, since a lazy result may still need it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that a column of df has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
