"""Vectors as bytes: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import prepare


def number_format(df: DataFrame, column: str) -> str:
    """'<f4' for arrays of float, '<f8' for all others."""
    return "<f4" if isinstance(df.schema[column].dataType.elementType, FloatType) else "<f8"


def encode(df: DataFrame, key: str, column: str) -> DataFrame:
    """(uid, key, vec): each row with its vector's bytes; null for vectors that are null, zero or not finite throughout.

    uid tells rows apart; it is fixed only once the result is written. Negative zeros become zeros.
    """
    prepare(df.sparkSession)
    fmt = number_format(df, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b[column]
            out: list[bytes | None] = []
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(fmt) + 0
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                v = flat[a:z]
                out.append(v.tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.record_batch([b[key], pa.array(out, pa.binary())], names=[key, "vec"])

    coded = df.select(key, column).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, vec binary")
    return coded.withColumn("uid", F.monotonically_increasing_id())


def stack(cells, fmt: str) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    cells = list(cells)
    return np.frombuffer(b"".join(cells), fmt).reshape(len(cells), -1).astype(np.float64) if cells else np.zeros((0, 1))
