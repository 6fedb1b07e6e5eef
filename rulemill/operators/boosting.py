"""Second-order gradient boosting on histograms, and exact Shapley values of its trees.

Inputs become bins once. Rows with the same bins, label and weight are alike to all trees, so they are counted, and the
counts are written: for every tree the rows that it draws, row by row. The groups are kept in blocks, and a level of a
tree is one stage of tasks over them, without a shuffle or a plan of its own, since levels are many and small: a task
adds up gradients and hessians by (node, input, bin), and the driver, which sees nodes x inputs x bins numbers of each
task, or of the square root of many, adds these up and picks the splits. Sums are of whole numbers (gradients in 2^-20),
so they don't depend on the partitions. Groups are made again every few trees, with the margins so far; in between tasks
add the new trees'.

Shapley values follow the paths of a tree: of a leaf, only the inputs on its path count, and the expectation over a
subset of them is a product of what the row decides (0 or 1) and of the shares in which rows part at the nodes. The
weights of subsets are the coefficients of a polynomial that is extended input by input; each input's value takes the
polynomial without it. What a row decides on a path is one of 2^inputs patterns, so a leaf's values are tabulated once.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.tables import importable, materialize
from .cumulative import quantiles

_UNIT = float(2**20)
#: Trees between two countings of groups, and how many of a row's draws one number holds (a multiple of it).
_REWRITE, _BITS = 10, 60
#: Tasks that send a level's sums straight to the driver; of more, the square root of their number does.
_SENDERS = 64
#: Values that a task keeps of patterns of bins that it has explained.
_KNOWN = 1_000_000


@dataclass
class Tree:
    """Nodes by number, the root 0. feature is -1 at a leaf; bins up to `upto` go left, and missing values if missing_left."""

    feature: list[int] = field(default_factory=list)
    upto: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, x in ((self.feature, -1), (self.upto, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover), (self.gain, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def goes_left(self, node: int, bins: np.ndarray) -> np.ndarray:
        b = bins[:, self.feature[node]]
        return np.where(b == 0, self.missing_left[node], b <= self.upto[node])

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The last node that each row reaches."""
        at = np.zeros(len(bins), np.int64)
        for node in range(len(self.feature)):  # a node's children have larger numbers
            if self.feature[node] >= 0:
                here = np.flatnonzero(at == node)
                at[here] = np.where(self.goes_left(node, bins[here]), self.left[node], self.right[node])
        return at


@dataclass
class Boosted:
    """cuts[i] are the upper ends of the bins of inputs[i]; bin 0 holds missing values."""

    inputs: tuple[str, ...]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Rows of inputs as numbers of bins."""
        out = np.zeros(values.shape, np.uint16)
        for i, cuts in enumerate(self.cuts):
            column = values[:, i]
            out[:, i] = np.where(np.isnan(column), 0, 1 + np.searchsorted(cuts, column, "left"))
        return out

    def margins(self, bins: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """The sum of the trees' values, from tree `first` on, up to `last`."""
        out = np.zeros(len(bins))
        for tree in self.trees[first:last]:
            out += np.array(tree.value)[tree.nodes_of(bins)]
        return out


def cut_points(df: DataFrame, inputs: Sequence[str], bins: int) -> list[np.ndarray]:
    """The distinct quantiles of each input that make up to so many bins of like size."""
    found = quantiles(df, inputs, [k / bins for k in range(1, bins)])
    return [np.unique(np.array(found[c], np.float64)) for c in inputs]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of doubles as rows; nulls are NaN."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)


def _values(inputs: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in inputs]).alias("values")


def _packed(bins: np.ndarray) -> pa.Array:
    """Rows of bins as bytes."""
    rows, width = bins.shape
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, (rows + 1) * width * 2, width * 2, np.int32)), pa.py_buffer(np.ascontiguousarray(bins))])


def _rows_of(b: pa.RecordBatch, width: int) -> np.ndarray:
    column = b["bins"].cast(pa.binary())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint16).reshape(-1, width)


def _binned(df: DataFrame, model: Boosted, label: str, weight: str | None, salts: Sequence[int], share: float) -> DataFrame:
    """(y, w, bins, m0, ...): of the k-th tree, bit k % _BITS of m<k // _BITS> says whether it draws the row."""
    width, words = len(model.inputs), [salts[i : i + _BITS] for i in range(0, len(salts), _BITS)]
    names = ["y", "w", "bins", *[f"m{i}" for i in range(len(words))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                uid = b["uid"].to_numpy()
                drawn = [sum((_drawn(uid, salt, share).astype(np.int64) << k for k, salt in enumerate(word)), np.zeros(len(uid), np.int64)) for word in words]
                yield pa.RecordBatch.from_arrays([b["y"], b["w"], _packed(model.bins(_matrix(b["values"], width))), *[pa.array(d) for d in drawn]], names=names)

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    chosen = df.where(F.col(label).isNotNull()).select(F.monotonically_increasing_id().alias("uid"), F.col(label).cast("double").alias("y"), w.alias("w"), _values(model.inputs))
    return chosen.mapInArrow(run, ", ".join(["y double, w double, bins binary", *[f"{m} bigint" for m in names[3:]]]))


def _groups(rows: DataFrame, model: Boosted, first: int, last: int) -> DataFrame:
    """(y, w, bins, margin, d<k> for trees from first to last): rows that are alike, and how many each tree draws; written."""
    width = len(model.inputs)
    drawn = [F.sum(F.getbit(f"m{k // _BITS}", F.lit(k % _BITS)).cast("long")).alias(f"d{k}") for k in range(first, last)]
    counted = rows.groupBy("y", "w", "bins").agg(F.lit(0.0).alias("margin"), *drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins, margin = _rows_of(b, width), np.zeros(b.num_rows)
                for k in range(0, first, _REWRITE):
                    margin += model.margins(bins, k, k + _REWRITE)
                yield b.set_column(3, "margin", pa.array(margin))

    return materialize(counted.mapInArrow(run, counted.schema) if first else counted, "groups")


def _drawn(uid: np.ndarray, salt: int, share: float) -> np.ndarray:
    """A row's part in a tree's sample, from a mix of its number and the tree's."""
    x = uid.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < share


def _blocks(groups: DataFrame, model: Boosted, first: int, last: int) -> RDD:
    """(groups, bins, y, w, margin, d<first> to d<last - 1>) as bytes, a row a batch of groups; kept, for memory and disk, until the groups change."""
    drawn = [f"d{k}" for k in range(first, last)]
    width, names = len(model.inputs), ["groups", "bins", "y", "w", "margin", *drawn]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                parts = [_rows_of(b, width), *[b[c].to_numpy() for c in names[2:]]]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=names)

    return groups.mapInArrow(run, ", ".join(["groups bigint", *[f"{c} binary" for c in names[1:]]])).rdd.persist(StorageLevel.MEMORY_AND_DISK)


def _histograms(blocks: RDD, model: Boosted, first: int, tree: Tree, active: list[int], columns: list[int]) -> np.ndarray:
    """Sums of gradients and hessians of the next tree: active nodes x inputs x bins x 2, in units. first: the trees that margins lack.

    One stage of tasks over the kept blocks; their sums, as large as the result, are added up by the driver, or by tasks
    first where there are many.
    """
    width, own = len(model.inputs), f"d{len(model.trees)}"
    starts = np.cumsum([0, *[len(model.cuts[c]) + 2 for c in columns]])  # the columns' cells side by side
    cells, since = int(starts[-1]), Boosted(model.inputs, [], model.trees[first:])
    spot = np.full(max(active) + 1, -1)
    spot[active] = np.arange(len(active))

    def add(total: np.ndarray, block: Row) -> np.ndarray:
        bins = np.frombuffer(block["bins"], np.uint16).reshape(block["groups"], width)
        n = np.frombuffer(block[own], np.int64)
        at = tree.nodes_of(bins)
        node = np.where(at < len(spot), spot[np.minimum(at, len(spot) - 1)], -1)
        use = np.flatnonzero((node >= 0) & (n > 0))
        bins, n, node = bins[use], n[use], node[use]
        y, w, margin = (np.frombuffer(block[c], np.float64)[use] for c in ("y", "w", "margin"))
        p = 1 / (1 + np.exp(-(margin + since.margins(bins))))
        sums = n * np.rint(w * (p - y) * _UNIT), n * np.rint(w * p * (1 - p) * _UNIT)
        for k, c in enumerate(columns):
            cell = node * cells + starts[k] + bins[:, c]
            for s, x in enumerate(sums):
                total[s] += np.bincount(cell, x, total.shape[1]).astype(np.int64)
        return total

    sums = blocks.treeAggregate(np.zeros((2, len(active) * cells), np.int64), add, np.add, 1 if blocks.getNumPartitions() <= _SENDERS else 2)
    sums = sums.reshape(2, len(active), cells)
    out = np.zeros((len(active), len(columns), max(len(c) for c in model.cuts) + 2, 2))
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        out[:, k, : b - a] = np.moveaxis(sums[:, :, a:b], 0, 2)
    return out / _UNIT


@dataclass(frozen=True)
class Split:
    gain: float
    column: int
    upto: int
    missing_left: bool
    left: tuple[float, float]
    right: tuple[float, float]


def best_split(sums: np.ndarray, sizes: Sequence[int], ridge: float, least: float) -> Split | None:
    """The split of one node with the largest gain, from sums inputs x bins x (gradient, hessian); bin 0 is missing.

    The gain is the fall of the regularised second-order loss. Missing values go to the side that gains more, left on
    ties; of equal gains the first input and bin count. sizes: bins of each input without the missing one.
    """
    total = sums[0].sum(axis=0)
    part = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
    best: Split | None = None
    for k, n in enumerate(sizes):
        missing, upto = sums[k, 0], np.cumsum(sums[k, 1 : n + 1], axis=0)[:-1]
        if not len(upto):
            continue
        both = np.stack([upto + missing, upto], axis=1)  # bins x (missing left, missing right)
        rest = total - both
        gain = (part(both) + part(rest) - part(total)) / 2
        gain[(both[..., 1] < least) | (rest[..., 1] < least)] = -np.inf
        at = int(gain.argmax())
        if gain.flat[at] > 1e-9 and (best is None or gain.flat[at] > best.gain):
            b, side = divmod(at, 2)
            best = Split(float(gain.flat[at]), k, b + 1, side == 0, tuple(both[b, side]), tuple(rest[b, side]))
    return best


def fit(df: DataFrame, inputs: Sequence[str], label: str, weight: str | None = None, rounds: int = 100, depth: int = 4, rate: float = 0.1, rows_share: float = 0.8, columns_share: float = 0.8, bins: int = 64, ridge: float = 1.0, least: float = 1.0, seed: int = 42) -> Boosted:
    """Boosted trees for a label of 0 and 1. Null and NaN inputs are missing values; rows without a label are left out.

    Each tree draws its rows and its columns anew. least: the hessian that both sides of a split must have. A tree that
    finds no split is a single leaf.
    """
    importable(df.sparkSession)
    model = Boosted(tuple(inputs), cut_points(df, inputs, bins))
    salts = [seed * 1_000_003 + number for number in range(rounds)]
    rows = _binned(df, model, label, weight, salts, rows_share)
    if rounds > _REWRITE:
        rows = materialize(rows, "binned")
    sizes = [len(c) + 1 for c in model.cuts]
    for number in range(rounds):
        first = number - number % _REWRITE
        if number == first:
            last = min(rounds, first + _REWRITE)
            blocks = _blocks(_groups(rows, model, first, last), model, first, last)
        chosen = sorted(random.Random(salts[number]).sample(range(len(inputs)), max(1, int(columns_share * len(inputs)))))
        tree, active = Tree(), [0]
        tree.add(0.0, 0.0)
        for _ in range(depth):
            sums = _histograms(blocks, model, first, tree, active, chosen)
            if active == [0]:
                g, h = sums[0, 0].sum(axis=0)
                tree.value[0], tree.cover[0] = -g / (h + ridge) * rate, h
            after = []
            for node, own in zip(active, sums, strict=True):
                found = best_split(own, [sizes[c] for c in chosen], ridge, least)
                if found is None:
                    continue
                tree.feature[node], tree.upto[node], tree.missing_left[node], tree.gain[node] = chosen[found.column], found.upto, found.missing_left, found.gain
                tree.left[node], tree.right[node] = (tree.add(-g / (h + ridge) * rate, h) for g, h in (found.left, found.right))
                after += [tree.left[node], tree.right[node]]
            active = after
            if not active:
                break
        model.trees.append(tree)
        if number == last - 1:
            blocks.unpersist()
    return model


def importance_by_gain(model: Boosted) -> dict[str, float]:
    """The gain of all splits on each input."""
    out = dict.fromkeys(model.inputs, 0.0)
    for tree in model.trees:
        for f, g in zip(tree.feature, tree.gain, strict=True):
            if f >= 0:
                out[model.inputs[f]] += g
    return out


@dataclass(frozen=True)
class _Path:
    """One leaf: the nodes above it, the side taken at each, and what each pattern of decisions gives its inputs."""

    inputs: tuple[int, ...]
    steps: tuple[tuple[int, int, bool], ...]  # place among the inputs, node, left
    table: np.ndarray  # patterns x inputs


def subset_weights(zero: Sequence[float], one: np.ndarray, without: int) -> np.ndarray:
    """For each pattern (a row of one) the sum over subsets of the other inputs, weighted as Shapley's value asks.

    The polynomial with the factors zero + one * t is extended factor by factor; its coefficient of t^k sums the
    products over subsets of k inputs that are known.
    """
    n = len(zero)
    p = np.ones((len(one), 1))
    for i in range(n):
        if i != without:
            p = np.pad(p * zero[i], ((0, 0), (0, 1))) + np.pad(p * one[:, i : i + 1], ((0, 0), (1, 0)))
    return p @ np.array([factorial(k) * factorial(n - 1 - k) / factorial(n) for k in range(n)])


def _paths(tree: Tree) -> list[_Path]:
    out: list[_Path] = []

    def walk(node: int, steps: list[tuple[int, int, bool, float]]) -> None:
        if tree.feature[node] >= 0:
            for child, left in ((tree.left[node], True), (tree.right[node], False)):
                share = tree.cover[child] / tree.cover[node] if tree.cover[node] > 0 else 0.0
                walk(child, [*steps, (tree.feature[node], node, left, share)])
            return
        inputs = tuple(dict.fromkeys(f for f, *_ in steps))
        zero = [float(np.prod([s for f, _, _, s in steps if f == i])) for i in inputs]
        one = (np.arange(2 ** len(inputs))[:, None] >> np.arange(len(inputs)) & 1).astype(np.float64)
        each = [tree.value[node] * (one[:, i] - zero[i]) * subset_weights(zero, one, i) for i in range(len(inputs))]
        table = np.stack(each, axis=1) if each else np.zeros((1, 0))
        out.append(_Path(inputs, tuple((inputs.index(f), n, left) for f, n, left, _ in steps), table))

    walk(0, [])
    return out


def expected_margin(model: Boosted) -> float:
    """The trees' mean value, as rows part at their nodes."""

    def mean(tree: Tree, node: int) -> float:
        if tree.feature[node] < 0 or tree.cover[node] <= 0:
            return tree.value[node]
        return sum(tree.cover[c] / tree.cover[node] * mean(tree, c) for c in (tree.left[node], tree.right[node]))

    return sum(mean(t, 0) for t in model.trees)


class Explainer:
    """Shapley values of rows; the tables are bounded by rounds and depth, and go to the tasks with the function."""

    def __init__(self, model: Boosted):
        self.model, self.paths = model, [_paths(t) for t in model.trees]

    def values(self, bins: np.ndarray) -> np.ndarray:
        """Rows x inputs; with the expected margin they sum to the row's margin."""
        out = np.zeros((len(self.model.inputs), len(bins)))
        for tree, paths in zip(self.model.trees, self.paths, strict=True):
            left = {n: tree.goes_left(n, bins) for n in range(len(tree.feature)) if tree.feature[n] >= 0}
            for path in paths:
                follows = np.ones((len(path.inputs), len(bins)), bool)
                for i, node, side in path.steps:
                    follows[i] &= left[node] == side
                pattern = np.zeros(len(bins), np.int64)
                for i in range(len(path.inputs)):
                    pattern |= follows[i].astype(np.int64) << i
                for i, f in enumerate(path.inputs):
                    out[f] += path.table[pattern, i]
        return out.T


class _Known:
    """Values of patterns of bins that a task has met, as many as fit; rows repeat them where inputs have few bins."""

    def __init__(self, find, inputs: int, values: int):
        self.find, self.inputs, self.most = find, inputs, _KNOWN // max(1, values)
        self.at: dict[bytes, int] = {}
        self.values = np.zeros((0, values))

    def of(self, bins: np.ndarray) -> np.ndarray:
        size, raw = 2 * self.inputs, np.ascontiguousarray(bins).tobytes()
        keys = [raw[i : i + size] for i in range(0, len(raw), size)]
        new = list(dict.fromkeys(k for k in keys if k not in self.at))
        if new:
            if len(self.at) + len(new) > self.most:
                self.at, self.values, new = {}, self.values[:0], list(dict.fromkeys(keys))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.values = np.concatenate([self.values, self.find(np.frombuffer(b"".join(new), np.uint16).reshape(-1, self.inputs))])
        return self.values[np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))]


def shapley_values(df: DataFrame, model: Boosted, keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns, margin, and contributions (an array in the order of the model's inputs) of each row."""
    importable(df.sparkSession)
    explainer, width = Explainer(model), len(model.inputs)
    chosen = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], _values(model.inputs))
    names = [*[f"k{i}" for i in range(len(keep))], "margin", "contributions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(lambda bins: np.c_[model.margins(bins), explainer.values(bins)], width, width + 1)
        for b in batches:
            if b.num_rows:
                told = known.of(model.bins(_matrix(b["values"], width)))
                found = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * width + 1, width), pa.int32()), pa.array(told[:, 1:].ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(told[:, 0]), found], names=names)

    kinds = [f"{n} {chosen.schema[n].dataType.simpleString()}" for n in names[:-2]]
    return chosen.mapInArrow(run, ", ".join([*kinds, "margin double", "contributions array<double>"])).toDF(*keep, "margin", "contributions")


def _patterns(df: DataFrame, model: Boosted, *keep: str) -> DataFrame:
    """(bins, the columns to keep, n): how many rows are alike."""
    importable(df.sparkSession)
    width = len(model.inputs)
    chosen = df.select(_values(model.inputs), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([_packed(model.bins(_matrix(b["values"], width))), *b.columns[1:]], names=["bins", *keep])

    kinds = [f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep]
    return chosen.mapInArrow(run, ", ".join(["bins binary", *kinds])).groupBy("bins", *keep).agg(F.count("*").alias("n"))


def mean_contributions(df: DataFrame, model: Boosted) -> dict[str, float]:
    """The mean absolute Shapley value of each input: one pass that counts rows with the same bins, which are explained once."""
    explainer, width = Explainer(model), len(model.inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width)
        for b in batches:
            if b.num_rows:
                alike = b["n"].to_numpy()
                total += alike @ np.abs(explainer.values(_rows_of(b, width)))
                n += int(alike.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total), pa.array([n] * width, pa.int64())], names=["at", "total", "n"])

    sums = _patterns(df, model).mapInArrow(run, "at bigint, total double, n bigint").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = {r["at"]: r["total"] / r["n"] for r in sums.collect() if r["n"]}  # a row an input
    return {c: found.get(i, 0.0) for i, c in enumerate(model.inputs)}


def accuracy(df: DataFrame, model: Boosted, label: str) -> DataFrame:
    """rows, right, accuracy of the trees on rows with a label."""
    width = len(model.inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["y"], b["n"], pa.array(model.margins(_rows_of(b, width)))], names=["y", "n", "margin"])

    labelled = df.where(F.col(label).isNotNull()).withColumn("_y", F.col(label) == 1)
    told = _patterns(labelled, model, "_y").select("bins", F.col("_y").alias("y"), "n").mapInArrow(run, "y boolean, n bigint, margin double")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows, right = total(F.col("n")), total(F.when((F.col("margin") > 0) == F.col("y"), F.col("n")))
    return told.agg(rows.alias("rows"), right.alias("right"), F.coalesce(F.try_divide(right, rows), F.lit(0.0)).alias("accuracy"))


def margins(df: DataFrame, model: Boosted, keep: Sequence[str]) -> DataFrame:
    """The kept columns and the margin of each row."""
    importable(df.sparkSession)
    width, names = len(model.inputs), [f"k{i}" for i in range(len(keep))]
    chosen = df.select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], _values(model.inputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.margins(model.bins(_matrix(b["values"], width))))], names=[*names, "margin"])

    kinds = [f"{n} {chosen.schema[n].dataType.simpleString()}" for n in names]
    return chosen.mapInArrow(run, ", ".join([*kinds, "margin double"])).toDF(*keep, "margin")
