"""Packing of documents into token sequences by Karmarkar-Karp multiway differencing.

A document is cut into full sequences and a rest; rests are cut at multiples of a piece length and packed. Pieces are
dealt by hash into groups of bounded size, and each group is split into windows: partial partitions with the largest
imbalance are merged two at a time, the largest windows of one with the smallest of the other, until one is left. If
any window exceeds the capacity, the number of windows rises and the group is split anew.

Defined results: a null text is an empty one and holds the end id alone; null and repeated keys each come back as
documents of their own; equal lengths are taken in the order of piece numbers; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, prepare

#: Pieces in a group, on average: bounds the memory and time of one call.
GROUP_PIECES = 1024
#: Rests are cut at multiples of this. Shorter pieces balance better and cut documents more often.
PIECE = 512
_PIECES = "piece_id long, {key} {kind}, start long, length long, doc_tokens long, ids binary"


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each window, at most `windows` of them, with near-equal sums.

    A partial partition is the list of its windows that hold something, by sum descending; the others are empty.
    """
    order = np.argsort(-sizes, kind="stable")
    singles = [(int(sizes[i]), int(i)) for i in order]
    heap: list[tuple[int, int, list[int], list[list[int]]]] = []  # (-imbalance, number, sums, items)
    at, made = 0, 0

    def take() -> tuple[list[int], list[list[int]]]:
        """The partial partition with the largest imbalance, a lone item included."""
        nonlocal at
        if at < len(singles) and (not heap or singles[at][0] >= -heap[0][0]):
            at += 1
            return [singles[at - 1][0]], [[singles[at - 1][1]]]
        return heapq.heappop(heap)[2:]

    while at < len(singles) or len(heap) > 1:
        (a, x), (b, y) = take(), take() if at < len(singles) or heap else ([], [])
        if len(a) + len(b) > windows:
            # the largest of one meet the smallest of the other; an empty window is the smallest there is
            a, b = a + [0] * (windows - len(a)), [0] * (windows - len(b)) + b[::-1]
            x, y = x + [[] for _ in range(windows - len(x))], [[] for _ in range(windows - len(y))] + y[::-1]
            sums = [p + q for p, q in zip(a, b, strict=True)]
            items = [p + q for p, q in zip(x, y, strict=True)]
        else:
            sums, items = a + b, x + y
            # lone items that come next would be merged one by one, as long as a window stays empty
            while at < len(singles) and len(sums) < windows and singles[at][0] <= sums[-1] and (not heap or singles[at][0] >= -heap[0][0]):
                sums.append(singles[at][0])
                items.append([singles[at][1]])
                at += 1
        rank = sorted(range(len(sums)), key=lambda i: -sums[i])
        sums, items = [sums[i] for i in rank], [items[i] for i in rank]
        while sums and not sums[-1]:
            sums.pop()
            items.pop()
        made += 1
        imbalance = sums[0] - (sums[-1] if len(sums) == windows else 0) if sums else 0
        heapq.heappush(heap, (-imbalance, made, sums, items))
    return heap[0][3] if heap else []


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; every window holds capacity at most."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        found = difference(lengths, windows)
        most = max((int(lengths[w].sum()) for w in found), default=0)
        if most <= capacity:
            break
        windows += max(1, windows // 200)
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for no, items in enumerate(found):
        window[items] = no
        offset[items] = np.cumsum(lengths[items]) - lengths[items]
    return window, offset


def _cutter(tokenizer: str, end_id: int, capacity: int, piece: int, key: str, text: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .word_ids import word_ids

        words, end, no = word_ids(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            for k, ids in zip(batch[key].to_pylist(), words.encode(batch[text].to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                full = n - n % capacity
                cuts = [*range(0, full, capacity), *range(full, n, piece), n]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows.append((no, k, a, b - a, n, ids[4 * a : 4 * b]))
                    no += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, piece: int = PIECE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with their ids (unsigned 32-bit bytes), written to the shared folder."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = pa.schema([("piece_id", pa.int64()), (key, to_arrow_type(docs.schema[key].dataType)), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    return materialize(docs.select(key, text).mapInArrow(_cutter(tokenizer, end_id, capacity, piece, key, text, schema), _PIECES.format(key=key, kind=kind)), "pieces")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (piece_id, length, any others) with sequence_id and offset; full pieces are sequences of their own."""
    prepare(pieces.sparkSession)
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece_id", ignore_index=True)
        window, offset = pack_group(frame["length"].to_numpy(), capacity)
        frame["sequence_id"], frame["offset"] = frame.pop("_group") * (1 << 24) + window, offset
        return frame

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"])
    packed = rest.withColumn("_group", F.pmod(F.xxhash64("piece_id"), F.lit(groups))).groupBy("_group").applyInPandas(split, schema)
    # numbers of full ones are negative, those of windows are not
    return packed.unionByName(full.withColumn("sequence_id", -1 - F.col("piece_id")).withColumn("offset", F.lit(0).cast("long")))
