"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected on a few random directions, several times over, each time shifted in its grid and numbered along
a Hilbert curve. Every ordering is range-partitioned and sorted by Spark, which gives each row its rank. A query looks
at the rows whose rank is within a window of its own, in every ordering; the windows merge and are reranked by the
exact inner product of the original vectors.

For inner products, vectors get one more component that makes all norms equal (queries: zero), so that the largest
product is the smallest angle.

The window is a fixed number of rows, and raised only as far as a measurement asks: a bounded sample of the queries is
compared with all vectors, and the window is the least that holds the wanted share of their true neighbours in some
ordering. On clustered vectors it stays small however large the table; on vectors without any structure recall needs
a window that grows with the table, whatever the index.

Scores are sums of products from the first component to the last in double precision, so they don't depend on how rows
meet; sums that overflow are infinite.

Defined results: vectors that are null, zero or hold null or non-finite components, and those of another length than
the most frequent one take no part; rows with a null key ask nothing and are found, after others at ties; equal vectors are indexed once, with their smallest keys,
so copies lose nothing; repeated keys are rows of their own; ties go to the smaller key; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import encode, number_format, stack

#: Orderings, directions and bits of each, the least window to either side, rows of a block.
ORDERINGS, DIRECTIONS, BITS, WINDOW, BLOCK = 8, 6, 5, 1024, 8192
#: Queries that are compared with all vectors, and the share of their true neighbours that windows must hold.
MEASURED, HELD = 128, 0.95
_SALTS = 64


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner product of each row of x with that of y, summed in the order of the components."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for a, b in zip(x.T, y.T, strict=True):
            out += a * b
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows that aren't zero; no square over- or underflows."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points on a grid (n x directions, each below 2 ** bits).

    Skilling's transform: undo the excess rotations and reflections bit by bit, Gray-code, interleave the bits.
    """
    x = grid.T.astype(np.int64)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in x:
            swap = np.where((axis >> bit) & 1, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where((axis >> bit) & 1, below, swap)
            axis ^= swap if axis is not x[0] else 0
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> bit & 1)
    return key


class _Orderings:
    """Random directions and shifts; the grid spans the projections' range given with each call."""

    def __init__(self, width: int, orderings: int, directions: int, bits: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        directions = min(directions, width)
        self.bits = bits
        self.axes = [np.linalg.qr(rng.normal(size=(width, directions)))[0] for _ in range(orderings)]
        self.shift = rng.random((orderings, directions))

    def project(self, x: np.ndarray) -> np.ndarray:
        """All projections of all orderings, side by side."""
        return x @ np.concatenate(self.axes, axis=1)

    def keys(self, x: np.ndarray, no: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = np.clip((x @ self.axes[no] - low) / np.maximum(high - low, 1e-300), 0, 1)
        grid = ((at + self.shift[no] / 4) / 1.25 * (1 << self.bits)).astype(np.int64)
        return hilbert_keys(np.minimum(grid, (1 << self.bits) - 1), self.bits)


def _lift(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """Data get a last component that makes all norms 1; queries are unit vectors with a zero there."""
    if query:
        return np.concatenate([x / _norms(x)[:, None], np.zeros((len(x), 1))], axis=1)
    x = x / largest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def _ranges(classes: DataFrame, fmt: str, largest: float, orderings: _Orderings) -> dict[bool, np.ndarray]:
    """The 1 % and 99 % quantiles (2 x orderings x directions) of the projections of data (False) and of queries (True)."""
    count, each = orderings.shift.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, asks = stack(b["vec"].to_pylist(), fmt), b["query"].to_numpy(zero_copy_only=False).astype(bool)
            for kind, rows in ((False, x), (True, x[asks])):
                if len(rows):
                    found = orderings.project(_lift(rows, largest, kind))
                    yield pa.record_batch([pa.array(np.full(len(rows), kind)), *(pa.array(c) for c in found.T.copy())], names=["kind", *(f"p{i}" for i in range(count * each))])

    names = [f"p{i}" for i in range(count * each)]
    found = classes.mapInArrow(run, ", ".join(["kind boolean", *(f"{n} double" for n in names)]))
    got = found.groupBy("kind").agg(*[F.percentile_approx(n, [0.01, 0.99], 1000).alias(n) for n in names]).collect()
    return {r["kind"]: np.array([r[n] for n in names]).T.reshape(2, count, each) for r in got}


def _members(rows: DataFrame, key: str, k: int) -> DataFrame:
    """vec with its k + 1 smallest (key, uid), picked in salted parts first so that no task holds all copies."""
    part = rows.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(_SALTS)))
    first = Window.partitionBy("vec", "_salt").orderBy(F.col(key).asc_nulls_last(), "uid")
    few = part.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    again = Window.partitionBy("vec").orderBy(F.col(key).asc_nulls_last(), "uid")
    few = few.withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "uid"))).alias("members"))


def _ranked(classes: DataFrame, fmt: str, largest: float, width: int, orderings: _Orderings, count: int) -> DataFrame:
    """(o, rank, cid, query, vec): the rows of every ordering with their ranks; queries are rows of their own.

    A query's rank is the number of data rows before it.
    """
    ranges = _ranges(classes, fmt, largest, orderings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, asks = stack(b["vec"].to_pylist(), fmt), b["query"].to_numpy(zero_copy_only=False).astype(bool)
            for kind, some in ((False, np.arange(len(x))), (True, np.flatnonzero(asks))):
                if not len(some):
                    continue
                lifted, take = _lift(x[some], largest, kind), pa.array(some)
                for o in range(count):
                    h = orderings.keys(lifted, o, *ranges[kind][:, o])
                    yield pa.record_batch([pa.array(np.full(len(some), o, np.int32)), pa.array(h), b["cid"].take(take), pa.array(np.full(len(some), kind)), b["vec"].take(take)], names=["o", "h", "cid", "query", "vec"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            data = ~b["query"].to_numpy(zero_copy_only=False).astype(bool)
            yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(seen + np.cumsum(data) - data)], names=[*b.schema.names, "part", "i"])
            seen += int(data.sum())

    keyed = materialize(classes.mapInArrow(run, "o int, h long, cid long, query boolean, vec binary"), "curve-keys")
    order = ["o", "h", "cid", "query"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(index, "o int, h long, cid long, query boolean, vec binary, part int, i long")
    dealt = materialize(dealt, "curve-order")
    # a row for each partition and ordering in it: where its rows start in the partition, and in the ordering
    runs = dealt.groupBy("o", "part").agg(F.min("i").alias("first"), F.count_if(~F.col("query")).alias("rows"))
    before = Window.partitionBy("o").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("o", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return dealt.join(F.broadcast(runs), ["o", "part"]).select("o", (F.col("i") + F.col("shift")).alias("rank"), "cid", "query", "vec")


def _measured_window(classes: DataFrame, ranked: DataFrame, fmt: str, k: int, measured: int, held: float) -> int:
    """The least window that holds the share of the true k nearest of sampled queries; 0 without any.

    The sample is bounded, and so is all that follows from it: k neighbours of each of its queries.
    """
    asked = classes.where("query").select("cid", "vec").orderBy(F.xxhash64("cid"), "cid").limit(measured).collect()
    if not asked:
        return 0
    own, x = np.array([r["cid"] for r in asked], np.int64), stack([bytes(r["vec"]) for r in asked], fmt)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b["cid"].to_numpy()
            score = x @ stack(b["vec"].to_pylist(), fmt).T
            score[own[:, None] == ids[None]] = -np.inf
            take = min(k, len(ids))
            best = np.argpartition(-score, take - 1, axis=1)[:, :take]
            yield pa.record_batch([pa.array(np.repeat(own, take)), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(score, best, 1).ravel())], names=["ask", "cid", "score"])

    order = Window.partitionBy("ask").orderBy(F.desc("score"), "cid")
    true = classes.select("cid", "vec").mapInArrow(nearest, "ask long, cid long, score double").where(F.col("score") > float("-inf"))
    true = materialize(true.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("ask", "cid"), "true-neighbours")
    there = ranked.where("not query").select("o", "rank", "cid").join(F.broadcast(true), "cid")
    here = ranked.where("query").select("o", F.col("rank").alias("at"), F.col("cid").alias("ask")).join(F.broadcast(true.select("ask").distinct()), "ask")
    gaps = there.join(F.broadcast(here), ["o", "ask"]).groupBy("ask", "cid").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("gap"))
    found = sorted(r["gap"] for r in gaps.select("gap").collect())
    return found[int(np.ceil(held * len(found))) - 1] if found else 0


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", column: str = "embedding", orderings: int = ORDERINGS, window: int = WINDOW, block: int = BLOCK, measured: int = MEASURED, held: float = HELD) -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank, the key, score; nearest first.

    window is raised to what `measured` queries need to find the share `held` of their nearest; 0 measures none.
    """
    spark, fmt = df.sparkSession, number_format(df, column)
    kind = df.schema[key].dataType.simpleString()
    empty = f"query_id {kind}, rank int, `{key}` {kind}, score double"
    rows = materialize(encode(df, key, column).where("vec is not null"), "vectors")
    width = rows.groupBy(F.octet_length("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if width is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.octet_length("vec") == width["w"])
    asked = rows.withColumn("query", F.col(key).isNotNull() & F.coalesce(is_query, F.lit(False)))
    flags = asked.groupBy("vec").agg(F.bool_or("query").alias("query"))
    classes = materialize(flags.join(_members(rows, key, k), "vec").withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = stack(b["vec"].to_pylist(), fmt)
            yield pa.record_batch([pa.array([float(_norms(x).max())] if len(x) else [], pa.float64())], names=["m"])

    stats = classes.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    largest = classes.select("vec").mapInArrow(norms, "m double").agg(F.max("m")).first()[0]
    dims = width["w"] // int(fmt[-1])
    curves = _Orderings(dims + 1, orderings, DIRECTIONS, BITS)
    ranked = materialize(_ranked(classes.select("cid", "query", "vec"), fmt, largest, dims, curves, orderings), "curve-ranks")
    window = min(stats["n"], max(k + 1, window, _measured_window(classes, ranked, fmt, k, measured, held)))
    block = min(block, max(window, 256))
    # queries of a block come from the blocks within the window around it; they are dealt in parts of bounded size
    parts = max(1, -(-int(stats["q"] * min(1.0, (2 * window + block) / stats["n"])) // block))
    last = (stats["n"] - 1) // block
    rank, part = F.col("rank"), F.pmod(F.xxhash64("cid"), F.lit(parts))
    blocks = F.sequence(F.greatest(F.lit(0), F.floor((rank - window) / block)), F.least(F.lit(last), F.floor((rank + window) / block)))
    queries = ranked.where("query").select("o", F.explode(blocks).alias("b"), part.alias("p"), F.lit(True).alias("ask"), "rank", "cid", "vec")
    others = ranked.where("not query").select("o", F.floor(rank / block).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("p"), F.lit(False).alias("ask"), "rank", "cid", "vec")

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        q, c = frame[frame["ask"]], frame[~frame["ask"]]
        if not len(q) or not len(c):
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "cid": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        x, y, ids = stack(q["vec"], fmt), stack(c["vec"], fmt), c["cid"].to_numpy()
        c_rank, q_rank = c["rank"].to_numpy(), q["rank"].to_numpy()
        take, out, far = min(k + 1, len(c)), [], _norms(y).max()
        for a in range(0, len(x), 256):
            with np.errstate(over="ignore", invalid="ignore"):
                score = x[a : a + 256] @ y.T
            score[np.abs(c_rank[None] - q_rank[a : a + 256, None]) > window] = -np.inf
            best = np.argpartition(-score, take - 1, axis=1)[:, :take]
            # what ties with the last one stays too, up to what the order of summation may change
            edge = np.take_along_axis(score, best, 1).min(axis=1)
            edge = edge - np.where(np.isfinite(edge), 1e-13 * x.shape[1] * _norms(x[a : a + 256]) * far, 0)
            r, j = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
            out.append(pd.DataFrame({"query": q["cid"].to_numpy()[a + r], "cid": ids[j], "score": inner(x[a + r], y[j])}))
        return pd.concat(out)

    found = queries.unionByName(others).groupBy("o", "b", "p").applyInPandas(near, "query long, cid long, score double")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = stack(b["vec"].to_pylist(), fmt)
            yield pa.record_batch([b["cid"], b["cid"], pa.array(inner(x, x) if len(x) else [], pa.float64())], names=["query", "cid", "score"])

    # a query's own vector may lie outside its window, and its copies are found by it
    found = found.unionByName(classes.where("query").select("cid", "vec").mapInArrow(own, "query long, cid long, score double"))
    merged = found.groupBy("query", "cid").agg(F.max("score").alias("score"))
    members = classes.select("cid", "members", F.element_at("members", 1)["key"].alias("least"))
    best = merged.join(members, "cid").withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "cid"))).where(F.col("_r") <= k + 1)
    best = best.select("query", "score", F.explode("members").alias("m"))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("m.key").asc_nulls_last(), "m.uid"))).where(F.col("_r") <= k + 1)
    # every row that asks takes the list of its vector, without itself
    who = asked.where("query").select("uid", F.col(key).alias("query_id"), "vec").join(classes.select("vec", F.col("cid").alias("query")), "vec").drop("vec")
    lists = who.join(best.select("query", "score", F.col("m.key").alias(key), F.col("m.uid").alias("other")), "query").where("uid <> other")
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.col(key).asc_nulls_last(), "other")).cast("int"))
    return lists.where(F.col("rank") <= k).select("query_id", "rank", key, "score")
