"""Table sources and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own: list[str] = []


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return spark


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, every column as text. Given columns save a pass over the first lines."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path)


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or the context's checkpoint folder.

    Only a local master, whose tasks share a disk, gets a temporary folder instead; a cluster without one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='rulemill-tables-')}")
    return _own[0]


def run_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds what this session writes on the way."""
    return f"{shared_dir(spark)}/rulemill/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can reach it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def missing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that aren't there, wherever Spark can reach them; a run can ask before it begins."""

    def there(path: str) -> bool:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)

    return [p for p in paths if not there(p)]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back; the copy stays until `remove(spark, run_dir(spark))`."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
