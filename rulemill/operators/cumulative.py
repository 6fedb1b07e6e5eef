"""Running sums and exact quantiles of columns with any number of distinct values, without one task that holds them.

Values are counted once and the counts sorted by range. Sums of whole partitions are added to running sums within
each, so the results are exact wherever the ranges are cut, and a range never outgrows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import floor, nan

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import importable, materialize

_ROW_BITS = 33


def ranged(counts: DataFrame, group: str, value: str, descending: bool = False) -> DataFrame:
    """counts, one row a group and value, computed once and written in order, each row with the number of its range."""
    toward = F.desc if descending else F.asc
    ordered = materialize(counts.orderBy(group, toward(value)).withColumn("_at", F.monotonically_increasing_id()), "ordered-counts")
    return ordered.withColumn("_part", F.shiftright("_at", _ROW_BITS)).drop("_at")


def running_sums(counts: DataFrame, group: str, value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """counts with <sum>_run for each column of sums: its sum over the group's values up to each one, itself included.

    counts has one row a group and value, and is computed once. Groups are few (columns, features); their values may be
    very many.
    """
    return sums_over(ranged(counts, group, value, descending), group, value, sums, descending)


def sums_over(placed: DataFrame, group: str, value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """The running sums of `running_sums`, of counts that `ranged` has written."""
    toward = F.desc if descending else F.asc
    columns = [c for c in placed.columns if c != "_part"]
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy(group, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    base = whole.select(group, "_part", *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}") for s in sums])
    inside = Window.partitionBy(group, "_part").orderBy(toward(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    # base has a row a partition, and one more a group
    joined = own.join(F.broadcast(base), [group, "_part"])
    return joined.select(*columns, *[(F.col(f"_in_{s}") + F.col(f"_{s}")).alias(f"{s}_run") for s in sums])


#: Accuracy of the sketches, how far around a wanted share their bounds are taken, how many parts a stretch is cut into
#: when it is looked at again, and how many values of a stretch are collected.
_ACCURACY, _AROUND, _AGAIN, _FEW = 10_000, 0.0005, 200, 1_000


def _cells(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2i + 1 for the i-th bound itself, 2i for what lies before it and after the one before."""
    at = np.searchsorted(bounds, values, "left")
    same = np.zeros(len(values), bool)
    inner = at < len(bounds)
    same[inner] = bounds[at[inner]] == values[inner]
    return 2 * at + same


def _by_cell(df: DataFrame, bounds: Mapping[str, np.ndarray], cells: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """(c, cell, value, n): how many values each cell of a column has, value null; for given cells their values, counted a batch at a time.

    c is a column's place among the given cells' columns, or else among those with bounds; others aren't read.
    """
    names = list(bounds if cells is None else cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for c, name in enumerate(names):
                x = b[name].drop_null().to_numpy()
                x = x[~np.isnan(x)]
                at = _cells(x, bounds[name])
                if cells is None:
                    cell, n = np.unique(at, return_counts=True)
                    value = np.full(len(cell), np.nan)
                else:
                    value, n = np.unique(x[np.isin(at, cells[name])], return_counts=True)
                    cell = _cells(value, bounds[name])
                for column, found in zip(rows, (np.full(len(cell), c), cell, value, n), strict=True):
                    column.append(found)
            c, cell, value, n = (np.concatenate(r) for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(cell, pa.int64()), pa.array(value, pa.float64(), mask=np.isnan(value)), pa.array(n, pa.int64())], names=["c", "cell", "value", "n"])

    importable(df.sparkSession)
    return df.select(*names).mapInArrow(run, "c bigint, cell bigint, value double, n bigint")


def ranked_values(df: DataFrame, ranks: Mapping[str, Sequence[int]], totals: Mapping[str, int]) -> dict[tuple[str, int], float]:
    """The values at these ranks (from 0) of columns of doubles without NaN, without sorting a column. totals: values of each.

    Sketches give bounds around the ranks. One pass counts the values between and at the bounds, which tells exactly in
    which stretch a rank lies; a bound that is hit is the answer, and the values of a stretch with few are collected.
    A stretch with many is looked at again by sketches of its own, so it doesn't matter how good the bounds are. Later
    passes read only the columns that still have open ranks.
    """
    importable(df.sparkSession)
    names = list(ranks)
    bounds = {c: np.zeros(0) for c in names}
    counts: dict[str, dict[int, int]] = {c: {0: totals[c]} for c in names}
    while True:
        found: dict[tuple[str, int], float] = {}
        open_at: dict[tuple[str, int], list[tuple[int, int]]] = {}  # column, cell -> ranks and their places in the cell
        for c in names:
            cells = sorted(counts[c])
            ends = np.cumsum([counts[c][x] for x in cells])
            for r in ranks[c]:
                k = int(np.searchsorted(ends, r, "right"))
                if cells[k] % 2:
                    found[c, r] = float(bounds[c][cells[k] // 2])
                else:
                    open_at.setdefault((c, cells[k]), []).append((r, r - (int(ends[k - 1]) if k else 0)))
        large = [at for at in open_at if counts[at[0]][at[1]] > _FEW]
        if not large:
            break
        again = names
        if not any(len(b) for b in bounds.values()):  # nothing is known yet: one sketch a column
            sides = {c: sorted({min(1.0, max(0.0, r / totals[c] + d)) for r in ranks[c] for d in (-_AROUND, _AROUND)}) for c in names}
            row = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), sides[c], _ACCURACY).alias(c) for c in names]).first()
            more = {c: row[c] for c in names}
        else:
            again = list(dict.fromkeys(c for c, _ in large))
            inside = _by_cell(df, bounds, {c: [cell for d, cell in large if d == c] for c in again})
            sketch = inside.groupBy("c", "cell").agg(F.percentile_approx("value", [k / _AGAIN for k in range(_AGAIN + 1)], _ACCURACY).alias("p"))
            more = {c: [] for c in again}
            for r in sketch.collect():  # a row a stretch
                more[again[r["c"]]] += r["p"]
        bounds |= {c: np.unique(np.r_[bounds[c], more[c]]) for c in again}
        counts |= {c: {} for c in again}
        for r in _by_cell(df, {c: bounds[c] for c in again}).groupBy("c", "cell").agg(F.sum("n").alias("n")).collect():  # twice the bounds
            counts[again[r["c"]]][r["cell"]] = r["n"]
    if open_at:
        left = list(dict.fromkeys(c for c, _ in open_at))
        inside = _by_cell(df, bounds, {c: [cell for d, cell in open_at if d == c] for c in left})
        held: dict[tuple[str, int], list[tuple[float, int]]] = {}
        for r in inside.groupBy("c", "cell", "value").agg(F.sum("n").alias("n")).collect():  # few values a stretch
            held.setdefault((left[r["c"]], r["cell"]), []).append((r["value"], r["n"]))
        for at, wanted in open_at.items():
            own = sorted(held[at])
            ends = np.cumsum([n for _, n in own])
            for r, place in wanted:
                found[at[0], r] = own[int(np.searchsorted(ends, place, "right"))][0]
    return found


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of numeric columns with linear interpolation, nulls left out; an empty list without values.

    Three passes as a rule, each one aggregation without a sort: see `ranked_values`. NaN counts as the largest value.
    """
    if not columns:
        return {}
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    counted = rows.agg(*[F.struct(F.count(c).alias("n"), F.count_if(F.isnan(c)).alias("nan")).alias(c) for c in rows.columns]).first()
    totals = {c: counted[c]["n"] for c in rows.columns if counted[c]["n"]}
    plain = {c: n - counted[c]["nan"] for c, n in totals.items()}
    places = {c: [s * (n - 1) for s in shares] for c, n in totals.items()}
    wanted = {c: sorted({x for p in ps for x in (floor(p), min(floor(p) + 1, totals[c] - 1))}) for c, ps in places.items()}
    at = {(c, r): nan for c, rs in wanted.items() for r in rs if r >= plain[c]}
    ranks = {c: left for c, rs in wanted.items() if (left := [r for r in rs if r < plain[c]])}
    if ranks:
        at |= ranked_values(rows, ranks, plain)
    out: dict[str, list[float]] = {c: [] for c in columns}
    for i, name in enumerate(columns):
        c = f"c{i}"
        for p in places.get(c, []):
            low, part = floor(p), p - floor(p)
            a, b = at[c, low], at[c, min(low + 1, totals[c] - 1)]
            out[name].append(a if part == 0 or a == b else a + (b - a) * part)
    return out
