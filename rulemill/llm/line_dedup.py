"""Line dedup over a whole corpus.

Lines are hashed and dealt out by ranges of (hash, document, position), sorted likewise, and each partition is
streamed once. Runs inside a partition are decided on the spot; the first and last run of a partition, which may go on
next door, are decided with a table of two rows a partition. What returns is a compressed keep bitmap a document,
which is then applied to the text.

Because the document and the position are part of the range key, a line that a third of all documents hold is split
over as many partitions as it needs.

Defined results: a document is a distinct pair of key and text, so repeated rows count once and all come back; a
null or empty text is one empty line; null keys are documents like others; lines that are empty once stripped are kept
always; an empty table gives an empty result; other columns pass through. Keys are whole numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, prepare, released

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = "what string, h1 long, h2 long, doc long, th long, pos int, n int, docs long, lead boolean, part int, doc2 long, th2 long"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n", -1)
    keys = F.transform(lines, line_key)
    hashed = F.transform(keys, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))))
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("th"), F.posexplode(hashed).alias("pos", "h"), F.size(lines).alias("n")).where("h is not null").select("h.h1", "h.h2", "doc", "th", "pos", "n")


def _streamer(least: int, keep_first: bool):
    """Decides the lines of one sorted partition; carries at most the lines of fewer than least documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state: dict = {"key": None}
        schema = pa.schema([("what", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("docs", pa.int64()), ("lead", pa.bool_()), ("part", pa.int32()), ("doc2", pa.int64()), ("th2", pa.int64())])
        out: list[pa.RecordBatch] = []

        def lines(what: str, rows: pa.RecordBatch, lead: np.ndarray) -> None:
            n = rows.num_rows
            if n:
                fill = lambda v, t: pa.array([v] * n, t)
                out.append(pa.record_batch([fill(what, pa.string()), rows["h1"], rows["h2"], rows["doc"], rows["th"], rows["pos"], rows["n"], fill(None, pa.int64()), pa.array(lead), fill(part, pa.int32()), fill(None, pa.int64()), fill(None, pa.int64())], schema=schema))

        def edge(s: dict) -> None:
            (d1, t1), (d2, t2) = s["first"], s["last"]
            out.append(pa.record_batch([pa.array([x], f.type) for x, f in zip(["edge", *s["key"], d1, t1, None, None, s["docs"], None, part, d2, t2], schema, strict=True)], schema=schema))

        def close(s: dict, last: bool) -> None:
            """Ends the open run."""
            if s["key"] is None:
                return
            if s["opens"] or last:
                edge(s)
                for rows, lead in s["held"]:
                    lines("open", rows, lead)
            s["held"] = []

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch["h1"].to_numpy(), batch["h2"].to_numpy()
            doc = batch["doc"].fill_null(0).to_numpy()
            null, th = np.asarray(batch["doc"].is_null()), batch["th"].to_numpy()
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            starts = np.flatnonzero(new_run)
            ends = np.r_[starts[1:], len(h1)]
            new_doc = np.r_[True, (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (th[1:] != th[:-1])] | new_run
            counts = np.add.reduceat(new_doc, starts)
            at = lambda i: (None if null[i] else int(doc[i]), int(th[i]))
            drop, lead = np.zeros(len(h1), bool), new_run.copy()
            inner = np.flatnonzero(counts >= least)
            for k in range(len(starts)):
                # only the first and the last run of a batch can reach beyond it
                if k not in (0, len(starts) - 1):
                    continue
                a, b = int(starts[k]), int(ends[k])
                key = (int(h1[a]), int(h2[a]))
                goes_on = state["key"] == key
                if not goes_on:
                    close(state, False)
                    state = {"key": key, "docs": 0, "held": [], "first": at(a), "last": None, "opens": state["key"] is None, "sure": False}
                else:
                    lead[a] = False
                state["docs"] += int(counts[k]) - (goes_on and state["last"] == at(a))
                state["last"] = at(b - 1)
                rows, heads = batch.slice(a, b - a), lead[a:b]
                if state["sure"] or state["opens"]:
                    lines("drop" if state["sure"] else "open", rows, heads)
                else:
                    state["held"].append((rows, heads))
                if not state["opens"] and not state["sure"] and state["docs"] >= least:
                    state["sure"] = True
                    for r, h in state["held"]:
                        lines("drop", r, h)
                    state["held"] = []
            for k in inner:
                if k not in (0, len(starts) - 1):
                    drop[starts[k] : ends[k]] = True
            if drop.any():
                keep = pa.array(drop)
                lines("drop", batch.filter(keep), lead[drop])
            yield from out
            out.clear()
        close(state, True)
        yield from out

    return run


def find_repeats(docs: DataFrame, least: int = 10, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, pos, n) of every line to drop: lines whose key stands in least documents or more.

    keep_first keeps the first occurrence (smallest document, then position) of each such line.
    """
    spark = prepare(docs.sparkSession)
    order = ["h1", "h2", "doc", "th", "pos"]
    # range partitioning reads its input twice, once for the ranges: let that be the hashes, not the texts
    lines = materialize(_rows(docs, key, text), "line-hashes")
    dealt = lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    decided = materialize(dealt.mapInArrow(released(_streamer(least, keep_first)), _OUT), "line-runs")
    # two rows a partition at most: small enough to broadcast whatever the corpus
    edges = decided.where("what = 'edge'")
    before = Window.partitionBy("h1", "h2").orderBy("part")
    same = F.lag(F.struct("doc2", "th2")).over(before).eqNullSafe(F.struct(F.col("doc").alias("doc2"), F.col("th").alias("th2")))
    totals = edges.withColumn("docs", F.col("docs") - same.cast("long")).groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min("part").alias("first_part"))
    cut = ["doc", "th", "pos", "n"]
    sure, unsure = decided.where("what = 'drop'"), decided.where("what = 'open'").join(F.broadcast(totals), ["h1", "h2"]).where(F.col("total") >= least)
    if not keep_first:
        return sure.select(*cut).unionByName(unsure.select(*cut))
    # a run that is sure may have begun in an earlier partition
    sure = sure.join(F.broadcast(totals.select("h1", "h2", "first_part")), ["h1", "h2"], "left").where("not lead or first_part < part")
    return sure.select(*cut).unionByName(unsure.where("not lead or first_part < part").select(*cut))


def _bitmap(positions: pd.Series, n: pd.Series) -> pd.Series:
    def pack(p: np.ndarray, size: int) -> bytes:
        keep = np.ones(int(size), bool)
        keep[np.asarray(p, dtype=np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return pd.Series([pack(p, s) for p, s in zip(positions, n, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, least: int = 10, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, keep): for each document that loses lines, the zlib-compressed bits of the lines that stay."""
    drops = find_repeats(docs, least, keep_first, key, text)
    return drops.groupBy("doc", "th").agg(F.collect_set("pos").alias("p"), F.max("n").alias("n")).select("doc", "th", F.pandas_udf(_bitmap, "binary")("p", "n").alias("keep"))


def _kept(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    stay = [x for x, b in zip(lines, bits.tolist(), strict=True) if b]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """docs with their bitmaps, null for documents that lose nothing, and the name of that column."""
    doc, th, keep = free_names(docs, "_doc", "_th", "_keep")
    maps = bitmaps.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("keep").alias(keep))
    joined = docs.join(maps, F.col(key).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(th)), "left")
    return joined.drop(doc, th), keep


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """docs with the lines that stay; digest returns key, n_lines, n_dropped and kept_sha256 instead."""
    prepare(docs.sparkSession)
    if digest:
        joined, keep = _with_bitmaps(docs.select(key, text), bitmaps, key, text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [_kept(t, k) for t, k in zip(b[text].to_pylist(), b[keep].to_pylist(), strict=True)]
                yield pa.record_batch([b[key], pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0].encode()).hexdigest() for g in got], pa.string())], names=[key, "n_lines", "n_dropped", "kept_sha256"])

        return joined.mapInArrow(released(run), f"{key} {docs.schema[key].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")

    (joined, keep), names = _with_bitmaps(docs, bitmaps, key, text), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if k is None else _kept(t, k)[0] for t, k in zip(b[text].to_pylist(), b[keep].to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(texts, pa.string()) if n == text else b[n] for n in names], names=names)

    return joined.mapInArrow(released(cut), docs.schema)
