"""Vector code compression: product codebooks by Lloyd rounds whose sums are maintained by differences.

A vector is cut into equal parts, and each part is replaced by the number of the nearest entry of its position's
codebook. The state of a round is a written table of vectors with the codes of this round and the round before, and a
written table of running integer sums and counts of each entry. A round reads the state, assigns all parts, and writes
it anew; only parts whose code changed contribute to the sums, plus to the new entry and minus to the old one, added up
within each task before they are shuffled. All numbers are integers, so the sums are those that a full pass would give.

The codebooks, parts x entries x part length numbers, are bounded by the parameters; they alone go through the driver.

Defined results: rows whose vector is null or empty, holds null or non-finite components, or has another length than
the most frequent one are dropped; repeated rows each come back; null keys come after all others when the first
codebooks are taken, ties of the key are broken by the vector; with fewer vectors than entries a codebook has fewer
entries; an empty table gives an empty result; other columns are not read. Scaled components beyond a bound (2^28
divided by half the square root of the dimension, about) are cut to it, so that distances fit 64 bits; a label's sum
that doesn't fit is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare
from rulemill.sources.tables import remove

#: Labels with more than this part of all rows join by broadcast; there are fewer of them than this number.
_HOT = 1000


def bound_of(length: int) -> int:
    """The largest absolute component whose squared distances over a whole vector fit 64 bits."""
    return min(isqrt(2**60 // max(length, 1)) // 2, 2**31 - 1)


def scaled(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(k, l, ints, n): key, label, floor(scale * x) of all components as 32-bit bytes, and their number; unfit rows go."""
    prepare(df.sparkSession)
    chosen = df.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["v"]
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            good = np.isfinite(flat)
            whole = np.cumsum(np.r_[0, ~good])
            fit = (sizes > 0) & (whole[ends] == whole[ends - sizes])
            ints = []
            for i in np.flatnonzero(fit).tolist():
                m = bound_of(int(sizes[i]))
                ints.append(np.clip(np.floor(scale * flat[ends[i] - sizes[i] : ends[i]]), -m, m).astype("<i4").tobytes())
            kept = b.filter(pa.array(fit))
            yield pa.RecordBatch.from_arrays([kept["k"], kept["l"], pa.array(ints, pa.binary()), pa.array(sizes[fit], pa.int32())], names=["k", "l", "ints", "n"])

    kinds = f"k {chosen.schema['k'].dataType.simpleString()}, l {chosen.schema['l'].dataType.simpleString()}"
    return chosen.mapInArrow(run, f"{kinds}, ints binary, n int")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of book for each row of x, the first of equals, and the squared distance; exact for integers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 2**53:  # then doubles hold all of these integers
        a, c = x.astype(np.float64), book.astype(np.float64)
        d = (c * c).sum(axis=1) - 2 * (a @ c.T)
        code = d.argmin(axis=1)
        return code, (d[np.arange(len(x)), code] + (a * a).sum(axis=1)).astype(np.int64)
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i in range(len(x)):
        d = ((book - x[i]) ** 2).sum(axis=1)
        code[i], error[i] = d.argmin(), d.min()
    return code, error


def assign(state: DataFrame, books: np.ndarray, codes: str = "new") -> DataFrame:
    """The state with what was `new` as `old`, the codes of these books as `new`, and the error. books: parts x entries x length."""
    parts, entries, width = books.shape
    kind = "<u1" if entries <= 256 else "<u4"
    spec = f"k {state.schema['k'].dataType.simpleString()}, l {state.schema['l'].dataType.simpleString()}, ints binary, old binary, new binary, error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b["ints"].to_pylist()), "<i4").reshape(b.num_rows, parts, width).astype(np.int64)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            code = np.stack([c for c, _ in found], axis=1).astype(kind)
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([b["k"], b["l"], b["ints"], b["new"], pa.array([r.tobytes() for r in code], pa.binary()), pa.array(error, pa.int64())], names=["k", "l", "ints", "old", "new", "error"])

    return state.select("k", "l", "ints", "new").mapInArrow(run, spec)


def changes(state: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, at, change): plus and minus of all parts whose code changed; at is the component, or width for the count."""
    kind = "<u1" if entries <= 256 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b["ints"].to_pylist()), "<i4").reshape(b.num_rows, parts, width).astype(np.int64)
            x = np.concatenate([x, np.ones((b.num_rows, parts, 1), np.int64)], axis=2)
            new = np.frombuffer(b"".join(b["new"].to_pylist()), kind).reshape(-1, parts)
            old = [None if o is None else np.frombuffer(o, kind) for o in b["old"].to_pylist()]
            known = np.array([o is not None for o in old])
            before = np.stack([np.zeros(parts, kind) if o is None else o for o in old])
            for p in range(parts):
                moved = ~known | (before[:, p] != new[:, p])
                np.add.at(total[p], new[moved, p], x[moved, p])
                np.add.at(total[p], before[moved & known, p], -x[moved & known, p])
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in at] + [pa.array(total[at])], names=["part", "entry", "at", "change"])

    moved = state.where(F.col("old").isNull() | (F.col("old") != F.col("new"))).select("ints", "old", "new")
    return moved.mapInArrow(run, "part int, entry int, at int, change bigint").groupBy("part", "entry", "at").agg(F.sum("change").alias("change"))


def first_books(state: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """Each part of the vectors with the smallest keys."""
    rows = state.select("k", "ints").orderBy(F.col("k").asc_nulls_last(), "ints").limit(entries).collect()  # bounded by entries
    seeds = np.frombuffer(b"".join(bytes(r["ints"]) for r in rows), "<i4").astype(np.int64)
    return seeds.reshape(len(rows), parts, width).transpose(1, 0, 2).copy()


def moved_books(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries as the floors of their parts' means; those without parts stay. sums has parts x entries x (length + 1) rows at most."""
    total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for r in sums.collect():
        total[r["part"], r["entry"], r["at"]] = r["change"]
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of every fit vector, and the codebooks. code has a number in hex for each part.

    The state of a round is deleted when the next one's is written; the last one stays, since the result reads it.
    """
    spark = df.sparkSession
    ints = materialize(scaled(df, key, vector, label, scale), "vector-ints")
    length = ints.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = length[0]["n"] if length else parts
    if n % parts:
        raise ValueError(f"vectors of {n} components have no {parts} equal parts")
    width = n // parts
    state = ints.where(F.col("n") == n).select("k", "l", "ints", F.lit(None).cast("binary").alias("new"))
    books = first_books(state, parts, entries, width)
    sums = None
    written = [ints]
    for round_no in range(rounds):
        state = materialize(assign(state, books), f"codes-{round_no}")
        change = changes(state, parts, entries, width)
        if sums is not None:
            change = sums.unionByName(change).groupBy("part", "entry", "at").agg(F.sum("change").alias("change"))
        sums = materialize(change, f"sums-{round_no}")
        books = moved_books(books, sums)
        _drop(spark, written)
        written = [state]
    last = materialize(assign(state, books).select("k", "l", "new", "error"), "codes-final")
    _drop(spark, written)
    digits = F.lower(F.hex("new"))  # a byte a part
    return last.select(F.col("k").alias(key), F.col("l").alias(label), digits.alias("code"), "error"), books


def _drop(spark: SparkSession, written: list[DataFrame]) -> None:
    """Deletes tables that nothing reads any more."""
    for df in written:
        for path in df.inputFiles()[:1]:
            remove(spark, path.rsplit("/", 1)[0])


def label_errors(codes: DataFrame, key: str, label: str) -> DataFrame:
    """codes with label_error, the sum of error over rows with the same label, nulls together.

    Labels with over a thousandth of the rows, fewer than a thousand of them, join by broadcast, so that none is a hot key.
    """
    totals = materialize(codes.groupBy(label).agg(F.count("*").alias("n"), F.expr("try_sum(error)").alias("label_error")), "label-errors")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    small = totals.withColumnRenamed(label, "l")
    hot, cold = small.where(F.col("n") * _HOT > rows), small.where(F.col("n") * _HOT <= rows)
    same = codes[label].eqNullSafe(F.col("l"))
    often = codes.join(F.broadcast(hot), same).drop("l", "n")
    seldom = codes.join(F.broadcast(hot.select("l")), same, "left_anti").join(cold, same).drop("l", "n")
    return often.unionByName(seldom)


def books_sha256(books: np.ndarray) -> str:
    """Of all entries' components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
