"""Explanations of rows in batches by an injected explainer, such as a language model's client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.tables import importable

#: A batch of (row_id, features_json, label) to texts in the same order.
Explainer = Callable[[list[tuple[int, str, int]]], list[str]]


def template_explainer(batch: list[tuple[int, str, int]]) -> list[str]:
    """A deterministic stand-in for a model: one sentence from the features."""
    return [f"Row {i} with {features} ended in {'success' if label == 1 else 'failure'}." for i, features, label in batch]


def fault(texts: Sequence[object], wanted: int, least: int = 1, most: int | None = None) -> str | None:
    """What is wrong with a reply, None if nothing is: the first of not_list, wrong_count, missing_text, too_short, too_long."""
    if not isinstance(texts, (list, tuple)):
        return "not_list"
    if len(texts) != wanted:
        return "wrong_count"
    if not all(isinstance(t, str) for t in texts):
        return "missing_text"
    if any(len(t) < least for t in texts):
        return "too_short"
    return "too_long" if most is not None and any(len(t) > most for t in texts) else None


def _limited(error: Exception) -> bool:
    """Whether an error says that calls come too fast."""
    return "ratelimit" in type(error).__name__.lower() or "rate limit" in str(error).lower() or "429" in str(error)


def _ask(explainer: Explainer, rows: list[tuple], tries: int, wait: float, longer: float, least: int, most: int | None) -> tuple[list[str], int]:
    """One checked reply and the calls it took; a failed call or a faulty reply is tried again, after a longer wait if calls came too fast."""
    for left in range(tries - 1, -1, -1):
        try:
            got = explainer(rows)
            if wrong := fault(got, len(rows), least, most):
                raise ValueError(f"bad reply: {wrong}")
            return list(got), tries - left
        except Exception as e:
            if not left:
                raise
            time.sleep(longer if _limited(e) else wait)
    return [], 0


def words(text: str) -> int:
    """A stand-in for the number of tokens that a model counts."""
    return len(text.split())


def explain(records: DataFrame, explainer: Explainer = template_explainer, size: int = 30, tries: int = 3, wait: float = 2.0, longer: float = 60.0, least: int = 1, most: int | None = None, batch: str | None = None, keep: Sequence[str] = (), counted: bool = False, tokens: Callable[[str], int] = words) -> DataFrame:
    """row_id, label, explanation and the columns to keep; every reply is checked when it arrives.

    Batches are those that the column `batch` names, each one call, or else up to `size` rows of a task. counted adds
    what the replies took: calls of the row's batch, tokens of the row's prompt and reply; a batch that fails for good
    then has null explanations and its error, instead of stopping the job with all others.
    """

    importable(records.sparkSession)
    extra = ["calls", "prompt_tokens", "reply_tokens", "error"] if counted else []

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame[["row_id", "features_json", "label"]].itertuples(index=False, name=None))
        texts: list[str | None] = []
        calls: list[int] = []
        error: str | None = None
        for at in range(0, len(rows), size):
            some = rows[at : at + size]
            try:
                got, took = _ask(explainer, some, tries, wait, longer, least, most)
            except Exception as e:
                if not counted:
                    raise
                got, took, error = [None] * len(some), tries, f"{type(e).__name__}: {e}"
            texts += got
            calls += [took] * len(some)
        out = frame[["row_id", "label"]].assign(explanation=texts)[["row_id", "label", "explanation"]].join(frame[list(keep)])
        if counted:
            out = out.assign(calls=calls, prompt_tokens=[tokens(f) for _, f, _ in rows], reply_tokens=[tokens(t or "") for t in texts], error=error)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield told(frame)

    kind = lambda c: records.schema[c].dataType.simpleString()
    kinds = [f"{c} {'string' if c == 'error' else 'bigint'}" for c in extra]
    schema = ", ".join([f"row_id {kind('row_id')}", f"label {kind('label')}", "explanation string", *[f"`{c}` {kind(c)}" for c in keep], *kinds])
    if batch is None:
        return records.mapInPandas(run, schema)
    return records.groupBy(batch).applyInPandas(told, schema)


def asked_for(records: DataFrame) -> DataFrame:
    """records with asked, a digest of what a reply answers: the row's features and label."""
    return records.withColumn("asked", F.xxhash64("features_json", F.col("label").cast("string")))


def explain_resuming(records: DataFrame, path: str, explainer: Explainer = template_explainer, number: str = "row_no", batch: str = "batch", at_once: int = 200, **how: object) -> DataFrame:
    """Explains the batches that the log at path lacks, and returns the explanations of all rows of records.

    The log is a table of JSON lines partitioned by batch. A batch is explained if one of its rows has no reply to what
    is asked now, and its partition is overwritten as a whole, so that a batch that was cut short, or is done again,
    leaves no row twice. Up to at_once batches are one job. If some fail, the replies of the others are kept and the
    run stops with an error. records: row_id, features_json, label, number, batch; their batches are few (the first ones
    of a table).
    """
    spark, rows = records.sparkSession, asked_for(records)
    keep = (number, batch, "asked")
    schema = explain(rows, explainer, batch=batch, keep=keep, counted=True, **how).schema
    there = lambda: _stored(spark, path, schema).where("explanation is not null")
    same = ["row_id", "asked", batch]
    todo = rows.join(there().select(*same), same, "left_anti").select(batch).distinct()
    wanted = sorted(r[batch] for r in todo.collect())
    for at in range(0, len(wanted), at_once):
        some = wanted[at : at + at_once]
        told = explain(rows.where(F.col(batch).isin(some)), explainer, batch=batch, keep=keep, counted=True, **how)
        told.repartition(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).json(path)
        failed = _stored(spark, path, schema).where(F.col(batch).isin(some) & F.col("error").isNotNull()).select(batch, "error").distinct().orderBy(batch).collect()
        if failed:
            raise RuntimeError(f"{len(failed)} batches failed, the first is {failed[0][batch]}: {failed[0]['error']}")
    return there().join(rows.select(*same), same).select("row_id", "label", "explanation")


def counters(spark: SparkSession, path: str, batch: str = "batch") -> DataFrame:
    """batches, failed, calls, retries, prompt_tokens, reply_tokens of the log of replies at path."""
    return counted(_stored(spark, path, f"`{batch}` long, explanation string, calls long, prompt_tokens long, reply_tokens long, error string"), batch)


def counted(told: DataFrame, batch: str = "batch") -> DataFrame:
    """batches, failed, calls, retries, prompt_tokens, reply_tokens of counted explanations."""
    one = told.groupBy(batch).agg(F.max("calls").alias("calls"), F.bool_or(F.col("error").isNotNull()).alias("failed"), F.sum("prompt_tokens").alias("p"), F.sum("reply_tokens").alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    # a failed batch had no reply, so all of its calls but the first were retries too
    return one.agg(F.count("*").alias("batches"), F.count_if("failed").alias("failed"), total("calls").alias("calls"), total(F.col("calls") - 1).alias("retries"), total("p").alias("prompt_tokens"), total("r").alias("reply_tokens"))


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema)


def attach(explanations: DataFrame, records: DataFrame, complete: bool = True) -> DataFrame:
    """Explanations joined with their rows; complete: an explanation without a row raises."""
    joined = explanations.drop("label").join(records, "row_id", "left")
    if not complete:
        return joined.where("features_json is not null")
    return joined.where(F.when(F.col("features_json").isNull(), F.raise_error(F.concat(F.lit("no row for explanation "), F.col("row_id").cast("string"))).cast("boolean")).otherwise(True))
