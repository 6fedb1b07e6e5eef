"""The registered queries of the training-data operators: thin, over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_gru, hilbert_search, license_scan, line_dedup, merge_rounds, metric_join, packing, periodic_runs, secrets_ledger, sharding, simhash, token_files, vector_codes
from .common import shared_path, table

#: File names of the public vocabularies; the id that ends a document.
TOKENIZER, PIECES, END_ID = "word_bpe_49k.json", "piece_bpe_32k.model", 1


def vocabulary(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op2_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets_ledger.update_ledger(docs, shared_path(spark, "secret-ledger"))  # a new one: nothing was scanned before
    found = secrets_ledger.findings_by_path(docs, secrets_ledger.ledger_spans(ledger), ["doc_id"])
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[secrets_ledger.count_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets_ledger.describe(spans, base=True), 256).alias("base_sha256"),
        secrets_ledger.describe(spans).alias("spans"),
    )


def op6_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.cut_documents(docs, vocabulary(TOKENIZER), END_ID, capacity=2048)
    digests = pieces.select("piece_id", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack_pieces(digests, capacity=2048).drop("piece_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least=10), digest=True)


def op8_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = byte_gru.identify(docs, byte_gru.train(docs))
    return named.select("doc_id", byte_gru.held_out().alias("held_out"), "lang_pred", "score")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), END_ID)
    return token_files.read_token_files(spark, folder, manifest)


def op10_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_rounds.encode_documents(table(spark, sf_dir, "documents"), vocabulary(PIECES), digest=True)


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    told = vector_codes.label_errors(codes, "vec_id", "label")
    return told.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def op12_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, spans = F.col("places"), F.col("spans")
    return license_scan.find_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.get(places, 0)["start"].alias("first_word"),
        F.get(places, F.size(places) - 1)["start"].alias("last_word"),
        license_scan.labels(places).alias("base_labels"),
        license_scan.labels(spans).alias("labels"),
        license_scan.score(spans).alias("score"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in documents whose key's crc32 is divisible by 10 the words from some word on repeat with a period.

    A null key plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    said = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")).alias("w"))
    n = F.size("w").cast("long")
    placed = said.select("doc_id", "text", "g", "w", F.when(n > 0, F.col("g") % n).alias("a"))
    a, p = F.col("a"), (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).alias("p")
    shown = placed.select("doc_id", "text", "w", "a", p)
    turned = F.transform("w", lambda w, i: F.when(i < a, w).otherwise(F.get("w", (a + (i - a) % F.col("p")).cast("int"))))
    return shown.select("doc_id", F.when(a.isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_periods(table(spark, sf_dir, "documents")), least=6, times=4)
    runs = F.col("runs")
    order = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digests = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), order.alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return digests.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_metric_join, op2_hilbert_search, op3_rendezvous_sharding, op4_simhash_blocks, op5_secret_ledger, op6_differencing_packing, op7_line_dedup, op8_byte_gru, op9_token_files, op10_merge_rounds, op11_delta_lloyd, op12_diagonal_licenses, op13_periodic_runs)}
