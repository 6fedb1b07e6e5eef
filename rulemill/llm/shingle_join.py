"""Links by exact Jaccard similarity of word shingles, for `simhash.similar_groups`.

A text is keyed by the pigeonhole blocks of its fingerprint, and by bands of minima of its shingle hashes under random
permutations: two at similarity s share one of 16 bands of 4 with 1 - (1 - s^4)^16, 0.9998 at 0.8. Runs of texts with
one key in common are verified in their task by the exact similarity of the shingle sets; what returns are links that
span the run, never all its pairs. Runs longer than a bound are dealt as pairs of chunks to many tasks, and of keys
with the same texts one is verified.

Defined results: the case of ASCII letters doesn't count, ASCII white space separates words; a text of fewer words is
one shingle; texts without a word have none and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, released
from .long_runs import UNIT, run_links
from .shingles import fingerprint_of, shingle_hashes

BANDS, ROWS = 16, 4
#: Texts of one key in one task, or as many as have UNIT times so many shingles in all (a million), if that is fewer;
#: shingles hashed before their minima are taken.
CHUNK, _STEP = 1024, 4096


@lru_cache
def _factors(count: int) -> np.ndarray:
    """Odd numbers: each permutes the hashes, which are random themselves, by multiplication."""
    return np.random.default_rng(7).integers(0, 1 << 64, count, np.uint64) | np.uint64(1)


def _keys(parts: Sequence[bytes], seed: int) -> list[int]:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(p, seed + i) for i, p in enumerate(parts)], np.uint64).view(np.int64).tolist()


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A signed 64-bit key for every band of a text with shingles."""
    factors = _factors(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _STEP):
        least = np.minimum(least, (hashes[at : at + _STEP, None] * factors).min(axis=0))
    data, size = least.astype("<u8").tobytes(), 8 * rows
    return _keys([data[i * size : (i + 1) * size] for i in range(bands)], 0)


def block_keys(fp: int, masks: Sequence[int]) -> list[int]:
    """A signed 64-bit key for every choice of blocks of a fingerprint."""
    return _keys([(fp & m).to_bytes(8, "little") for m in masks], 1 << 20)


def spanning(sets: list[np.ndarray], side: np.ndarray | None, least: float) -> tuple[list[int], list[int]]:
    """Links that span what the pairs at least so similar connect. side: only pairs across the two sides count, if given."""
    a: list[int] = []
    b: list[int] = []
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)
    left = np.arange(len(sets)) if side is None else np.argsort(side, kind="stable")
    while len(left):
        frontier = [int(left[0])]
        left = left[1:]
        while frontier and len(left):
            at = frontier.pop()
            if side is not None and (side[left] == side[at]).all():
                continue
            own = number[starts[at] : starts[at] + sizes[at]]
            mark[own] = True
            both = np.add.reduceat(mark[number], starts, dtype=np.int64)[left]
            mark[own] = False
            near = both >= least * (sizes[at] + sizes[left] - both) - 1e-9
            if side is not None:
                near &= side[left] != side[at]
            if near.any():
                got = left[near].tolist()
                a += [at] * len(got)
                b += got
                frontier += got
                left = left[~near]
    return a, b


def _linker(words: int, least: float):
    """Sorted rows (k, c, d, side, node, text) to links: runs of equal (k, c, d) are compared."""

    def links(run: list[tuple]) -> pa.RecordBatch:
        side, nodes = np.array([r[3] for r in run]), np.array([r[4] for r in run], np.int64)
        x, y = spanning([np.unique(shingle_hashes(r[5], words)) for r in run], side if side.any() else None, least)
        return pa.record_batch([pa.array(nodes[np.array(x, np.int64)]), pa.array(nodes[np.array(y, np.int64)])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last run, which may go on in the next batch; two chunks at most
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("k", "c", "d", "side", "node", "text")), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    return run


def near_links(texts: DataFrame, words: int = 5, least: float = 0.8, masks: Sequence[int] = (), bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the rows (node, text) that connect all candidates at least so similar; a node is one row.

    masks: the choices of blocks of the fingerprint that key a text, besides its bands.
    """
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            nodes: list[int] = []
            loads: list[int] = []
            for node, text in zip(batch["node"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if len(found := shingle_hashes(text, words)):
                    keys += band_keys(found, bands, rows)
                    keys += block_keys(fingerprint_of(found), masks)
                    nodes += [node] * (bands + len(masks))
                    loads += [max(UNIT, len(found))] * (bands + len(masks))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(loads, pa.int64())], names=["k", "node", "load"])

    keyed = materialize(texts.select("node", "text").mapInArrow(released(run), "k long, node long, load long"), "text-keys")
    # keys with the same texts: one of them is verified
    mixed = F.xxhash64("node")
    runs = keyed.groupBy("k").agg(F.count("*").alias("count"), F.sum("load").alias("load"), F.min("node").alias("u"), F.max("node").alias("v"), F.bit_xor(mixed).alias("x")).where("count > 1")
    live = runs.groupBy("count", "load", "u", "v", "x").agg(F.min("k").alias("k")).select("k", F.ceil(F.col("load") / (chunk * UNIT)).cast("long").alias("n"))
    dealt = materialize(keyed.join(live, "k"), "text-runs")

    def attach(rows: DataFrame) -> DataFrame:
        return rows.join(texts.select("node", "text"), "node")

    def link(placed: DataFrame) -> DataFrame:
        key = ["k", "c", "d"]
        return placed.select(*key, "side", "node", "text").repartition(*key).sortWithinPartitions(*key).mapInArrow(released(_linker(words, least)), "a long, b long")

    return run_links(dealt.where("n = 1"), dealt.where("n > 1"), ["k"], "node", link, chunk, attach)
