"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Each record key gets a score for every shard, and the shard with the best score takes the record. Adding a shard
leaves the other scores as they are, so records move only into the new shard, and only its share of them moves.

Defined results: a null key is a key of its own (all null keys share a shard); repeated keys share a shard and get
different slots; a null text has no bytes, the checksum of no bytes (0) and the size of the fixed overhead alone;
an empty table gives an empty result. Columns of the input that are not asked for are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

def _unit(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) from the key and the shard number: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"@{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard with the largest weight / -ln(u); ties to the smaller number."""
    scores = [F.struct((F.lit(float(w)) / -F.log(_unit(key, s))).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["minus"]


def assign_shards(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Projects key, size, text_crc32, law, shard and grown_shard (the shard if there were one more of weight 1)."""
    weights = list(weights or [1.0] * shards)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + overhead).alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), [*weights, 1.0]).cast("int").alias("grown_shard"),
    )


def number_slots(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds slot, gapless from 0 in each shard, by key, then checksum.

    Rows are dealt out by ranges of (shard, key, checksum, row number), so that neither a shard nor a key with very many
    rows is one task's. Sorted, they are written with their place in their partition; a row for each shard and partition
    tells where the shard's rows start there.
    """
    order = ["shard", key, "text_crc32", "_row"]
    rows = materialize(assigned.withColumn("_row", F.monotonically_increasing_id()), "shards")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "shard-order")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    runs = placed.groupBy("shard", part.alias("_part")).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select("shard", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # shift has a row for each shard and range partition that meet: fewer than shards plus partitions
    return placed.withColumn("_part", part).join(F.broadcast(shift), ["shard", "_part"]).withColumn("slot", at + F.col("_shift"))


def shard_documents(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards all documents; returns key, size, text_crc32, law, shard, slot and grown_shard."""
    return number_slots(assign_shards(docs, shards, weights, key, text), key).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
