"""SimHash near-dedup with pigeonhole blocks.

Fingerprints are cut into six blocks. Two that differ in at most three bits agree on three blocks or more, so each
fingerprint is keyed by every choice of three blocks (20 keys of 32 or 33 bits). Keys are dealt out and sorted, and
each run of equal keys is verified by Hamming distance in the task; what returns are links that span the run, never
all its pairs. Runs longer than a bound are split (`long_runs`).

Defined results: a null, empty or blank text has fingerprint zero, which links like any other; equal fingerprints are
one class; null keys keep their row and never name a component; repeated rows each come back; an empty table gives an
empty result; texts count whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_join
from .common import materialize, prepare
from .components import connected_components
from .long_runs import run_links
from .shingles import fingerprint_of, shingle_hashes

#: Rows of one key in one task.
CHUNK = 8192


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is set if it is set in over half of the hashes of all word shingles, repeats included."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): each document's fingerprint as a signed 64-bit number."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b[text].to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b[key], pa.array(fps)], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def block_masks(bits: int = 3, blocks: int = 6) -> list[int]:
    """The masks of every choice of blocks - bits blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(c) for c in combinations(one, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _spanning(fps: np.ndarray, side: np.ndarray | None, bits: int) -> tuple[list[int], list[int]]:
    """Links that span what the pairs within reach connect. side: only pairs across the two sides count, if given."""
    a: list[int] = []
    b: list[int] = []
    left = np.arange(len(fps)) if side is None else np.argsort(side, kind="stable")
    while len(left):
        frontier = [int(left[0])]
        left = left[1:]
        while frontier and len(left):
            at = frontier.pop()
            if side is not None and (side[left] == side[at]).all():
                continue
            near = np.bitwise_count(fps[left] ^ fps[at]) <= bits
            if side is not None:
                near &= side[left] != side[at]
            if near.any():
                got = left[near]
                a += [at] * len(got)
                b += got.tolist()
                frontier += got.tolist()
                left = left[~near]
    return a, b


def _linker(bits: int):
    """Sorted rows (k, v, c, d, side, fp) to links: runs of equal (k, v, c, d) are compared."""

    def links(fps: np.ndarray, run: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        """run: True where a run starts."""
        first = np.flatnonzero(run)
        sizes = np.diff(np.r_[first, len(fps)])
        a, b = [], []
        two = first[sizes == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits
        a.append(two[near])
        b.append(two[near] + 1)
        for start, size in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = side[start : start + size]
            x, y = _spanning(fps[start : start + size], own if own.any() else None, bits)
            a.append(np.array(x, np.int64) + start)
            b.append(np.array(y, np.int64) + start)
        x, y = fps.view(np.int64)[np.concatenate(a)], fps.view(np.int64)[np.concatenate(b)]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the last run, which may go on in the next batch; two chunks at most
        for batch in batches:
            rows = np.stack([batch[c].to_numpy().astype(np.int64, copy=False) for c in ("k", "v", "c", "d", "side", "fp")])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            new = np.r_[True, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)] if rows.shape[1] else np.zeros(0, bool)
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0
            held = rows[:, last:]
            if last:
                yield links(np.ascontiguousarray(rows[5, :last]).view(np.uint64), new[:last], rows[4, :last])
        if held is not None and held.shape[1]:
            yield links(np.ascontiguousarray(held[5]).view(np.uint64), np.r_[True, np.zeros(held.shape[1] - 1, bool)], held[4])

    return run


def near_links(distinct: DataFrame, bits: int = 3, blocks: int = 6, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all that lie within bits of one another."""
    masks = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(block_masks(bits, blocks))])
    keyed = distinct.select("fp", F.explode(masks).alias("m")).select("fp", "m.k", "m.v")
    key = ["k", "v"]
    # keys with very many rows, few if any
    large = materialize(keyed.groupBy(*key).count().where(F.col("count") > chunk).select(*key, F.ceil(F.col("count") / chunk).cast("long").alias("n")), "long-keys")

    def link(placed: DataFrame) -> DataFrame:
        by = [*key, "c", "d"]
        return placed.repartition(*by).sortWithinPartitions(*by).mapInArrow(_linker(bits), "a long, b long")

    return run_links(keyed.join(large, key, "left_anti"), keyed.join(large, key), key, "fp", link, chunk)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, blocks: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, fingerprint (16 hexadecimal digits) and component_id, the smallest key reachable."""
    own = materialize(fingerprints(docs, words, key, text), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    comps = connected_components(near_links(classes.select("fp"), bits, blocks))
    named = classes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(least, "component").select("fp", "component_id"), "class-ids")
    return own.join(ids, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(texts: DataFrame, words: int = 5, least: float = 0.8, bits: int = 3, blocks: int = 6) -> DataFrame:
    """(node, component) of the rows (node, text) that links of a similarity of at least `least` connect to others.

    Texts whose fingerprints share a pigeonhole key, as above, are compared by the exact Jaccard similarity of their
    shingles. Two texts at 0.8 differ in about ten of 64 bits, beyond any radius that blocks can serve, so texts that
    share a band of minima are compared too; a node is one row.
    """
    return connected_components(shingle_join.near_links(texts, words, least, block_masks(bits, blocks)))
