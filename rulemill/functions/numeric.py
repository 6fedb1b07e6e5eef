"""Numeric column expressions: guarded parsing, ratios that never divide by zero, right-closed bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that counts as a number; try_cast alone would also take suffixes such as 1d.
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE = r"^\s*[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?\s*$"


def number(text: Column) -> Column:
    """The number that a text holds, null if it holds none; NaN is null."""
    return F.when(text.rlike(NUMBER) | text.rlike(INFINITE), F.trim(text).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def bin_number(value: Column, edges: Sequence[float]) -> Column:
    """The right-closed interval of edges that holds a value, from 0; the first edge and all outside are in bin 0."""
    over = sum((F.when(value > F.lit(float(e)), 1).otherwise(0) for e in edges[1:]), F.lit(0))
    return F.when(value > F.lit(float(edges[-1])), F.lit(0)).otherwise(over).cast("int")


def left_sum(terms: Sequence[Column]) -> Column:
    """Terms added from left to right, so that doubles come out as in a loop."""
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))
