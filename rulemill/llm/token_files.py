"""Token-ID output: binary files of ids in document order with Elias-Fano document boundaries.

Documents are dealt out by ranges of their key and sorted; each task encodes its range and writes files of bounded
size to a shared folder, under names of their own for each attempt. A manifest, committed by Spark, lists the files of
the attempts that count, so a retried task leaves no double rows. Reading deals slices of the files' documents to
tasks; a task selects its slice's boundaries and reads those ids only.

Defined results: a null text is an empty one and holds the end id alone; null keys come first; equal keys stand in
the order of their texts' hash; repeated rows each come back; an empty table gives an empty result; other columns are
not read. Keys are whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, shared_path

#: Ids (64 MB) or documents after which a file is closed, whichever comes first, and documents of a slice.
FILE_IDS, FILE_DOCS, SLICE = 32_000_000, 1_000_000, 8192
_MANIFEST = "part int, no int, file string, docs long, ids long"


def _writer(folder: str, tokenizer: str, end_id: int, key: str, text: str, file_ids: int, file_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        from .elias_fano import TokenFileWriter
        from .word_ids import word_ids

        task, words = TaskContext.get(), word_ids(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        end = np.array([end_id], "<u4").tobytes()
        width = 2 if max(words.size, end_id + 1) <= 1 << 16 else 4
        no, name, file = 0, "", None

        def close() -> pa.RecordBatch:
            file.finish()
            file.out.close()
            return pa.record_batch([pa.array([x], t) for x, t in ((task.partitionId(), pa.int32()), (no, pa.int32()), (name, pa.string()), (file.docs, pa.int64()), (file.ids, pa.int64()))], names=["part", "no", "file", "docs", "ids"])

        for batch in batches:
            for k, ids in zip(batch[key].to_pylist(), words.encode(batch[text].to_pylist()), strict=True):
                if file is None:
                    name = f"{task.partitionId():08d}-{no:05d}-{task.taskAttemptId()}.eft"
                    store.create_dir(root, recursive=True)
                    file = TokenFileWriter(store.open_output_stream(f"{root}/{name}"), width)
                file.add(k, ids + end)
                if file.ids >= file_ids or file.docs >= file_docs:
                    yield close()
                    no, file = no + 1, None
        if file is not None:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> tuple[str, DataFrame]:
    """Writes all documents in ascending key order; returns the folder and the manifest (part, no, file, docs, ids)."""
    spark = prepare(docs.sparkSession)
    folder = shared_path(spark, "token-files")
    keyed = docs.select(F.col(key).cast("long").alias(key), text).withColumn("_h", F.xxhash64(text)).withColumn("_row", F.monotonically_increasing_id())
    order = [key, "_h", "_row"]
    dealt = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select(key, text)
    return folder, materialize(dealt.mapInArrow(_writer(folder, tokenizer, end_id, key, text, file_ids, file_docs), _MANIFEST), "token-manifest")


def _starts(manifest: DataFrame) -> DataFrame:
    """file, docs, file_start: ids in all files before it. First over partitions, then within each."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("_sum"))  # one row a range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return manifest.join(base, "part").select("file", "docs", (F.col("_base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).cast("long").alias("file_start"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, key: str = "doc_id", ids: bool = False, docs: int = SLICE) -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32 (of all its ids as unsigned 32-bit), and ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from .elias_fano import TokenFile

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, a, b in zip(*(batch[c].to_pylist() for c in ("file", "file_start", "a", "b")), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:

                    def read(at: int, count: int, source=source) -> memoryview:
                        return memoryview(source.read_at(count, at))

                    f = TokenFile(read, source.size())
                    cuts = f.starts(a, b)
                    wide = f.ids(int(cuts[0]), int(cuts[-1])).astype("<u4")
                    own = (cuts - cuts[0]).tolist()
                    each = [wide[x:y] for x, y in zip(own[:-1], own[1:], strict=True)]
                    columns = [pa.array(f.keys(a, b), pa.int64()), pa.array(cuts[:-1] + start), pa.array(np.diff(cuts)), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.record_batch(columns + ([pa.array([x.tolist() for x in each], pa.list_(pa.int64()))] if ids else []), names=[key, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(docs).cast("long"))).alias("a")
    slices = _starts(manifest).select("file", "file_start", "docs", first).select("file", "file_start", "a", F.least("docs", F.col("a") + docs).alias("b"))
    # a few bytes a slice; dealt out by number, so that small rows don't end up in one task
    dealt = slices.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "a")
    return dealt.mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
