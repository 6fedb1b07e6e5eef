"""Numbering of rows in a global order without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize

_ROW_BITS = 33


def number_rows(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """df with its rows numbered from 0 in order. The order's columns should tell rows apart.

    Rows are sorted by range and written with their place in their partition; a row a partition gives the offsets.
    """
    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + at).drop("_part", "_at", "_before")


def batches(numbered: DataFrame, size: int = 30, first: int | None = 17, number: str = "row_no") -> DataFrame:
    """Rows with batch, the first batches only if a number is given."""
    out = numbered.withColumn("batch", F.floor(F.col(number) / size).cast("long"))
    return out if first is None else out.where(F.col("batch") < first)
