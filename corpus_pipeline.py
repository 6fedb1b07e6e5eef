"""Cleans and packs the documents table in five stages, each written as Parquet and read again by the next.

1. language: documents without a letter go, and those that the network takes for noise.
2. lines: lines that stand in ten documents or more go from every document.
3. near_duplicates: of each group of near-equal documents (five words, Jaccard 0.8) the one with the smallest doc_id stays.
4. secrets: every stretch of text that a secret rule finds is masked.
5. pack: what is left becomes token sequences of 2048 with little padding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.llm import byte_gru, line_dedup, packing, secrets_ledger, simhash
from rulemill.llm.common import free_names, materialize, prepare, shared_path, table
from rulemill.llm.queries import END_ID, TOKENIZER, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose predicted language is `und`: without text or a letter, or noise to the network.

    What it is to reject is text in no language: encoded data, random characters, scripts the labels don't know. The
    evidence for noise is summed over all of a text's positions and held against one prior, whatever its length; texts
    in a language with symbols between the words stay. Where nothing is labelled the network can't learn, and documents
    with a letter stay.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]  # so that no column is named like a result
    model, text = byte_gru.train(docs, noise=True), plain[docs.columns.index("text")]
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = byte_gru.identify(docs.toDF(*plain), model, text=text, keep=tuple(plain))
    return named.where(F.col("lang_pred") != byte_gru.NOISE).select(*plain).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more share; a document may end up empty and stays."""
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least=10))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of texts that five-word Jaccard similarities of 0.8 connect.

    Rows are told apart by their texts, not their doc_id, so different texts under one doc_id both stay. A null doc_id
    comes after all others; texts without a word are one group.
    """
    node, component, rank = free_names(docs, "_n", "_g", "_r")
    # hashes are compared, so that no text is sorted; ranks are cut before the shuffle, so a group is no hot key
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.xxhash64(*docs.columns)]
    said = F.when(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.col("text"))
    copies = Window.partitionBy(F.xxhash64(said), F.xxhash64(F.lit(7), said)).orderBy(*order)
    one = materialize(docs.withColumn(rank, F.row_number().over(copies)).where(F.col(rank) == 1).drop(rank).withColumn(node, F.monotonically_increasing_id()), "texts")
    groups = simhash.similar_groups(one.select(F.col(node).alias("node"), "text"), words=5, least=0.8)
    named = one.join(groups.select(F.col("node").alias(node), F.col("component").alias(component)), node, "left")
    first = Window.partitionBy(F.coalesce(component, node)).orderBy(*order)
    return named.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, found by way of a ledger; no document goes."""
    ledger = secrets_ledger.update_ledger(docs, shared_path(spark, "secret-ledger"))
    return secrets_ledger.redact_documents(docs, secrets_ledger.ledger_spans(ledger))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = packing.cut_documents(docs, vocabulary(TOKENIZER), END_ID, capacity=2048)
    digests = pieces.select("piece_id", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack_pieces(digests, capacity=2048).drop("piece_id")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("pack", pack)]
#: A trained network decides the first stage and a tokenizer the last: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
