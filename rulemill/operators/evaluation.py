"""Held-out evaluation: confusion matrix, metrics, examples and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import f1, precision, recall
from ..functions.text import clip, fixed, table_cell
from ..spec import Rule
from .combining import score
from .rules import predicate


def confusion(df: DataFrame, predicted: Column, label: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 from one aggregation."""
    y = F.col("_y") == 1
    one = df.select(F.coalesce(predicted, F.lit(False)).alias("_p"), F.col(label).alias("_y")).agg(
        F.count_if(F.col("_p") & y).alias("tp"), F.count_if(F.col("_p") & ~y).alias("fp"), F.count_if(~F.col("_p") & y).alias("fn"), F.count_if(~F.col("_p") & ~y).alias("tn")
    )
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return one.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def evaluate(df: DataFrame, rules: Sequence[Rule], cutoff: float, label: str, method: str = "precision_weighted") -> DataFrame:
    """Metrics of `score >= cutoff`, with the cut-off and the number of predictions."""
    return confusion(df, score(rules, method) >= cutoff, label).withColumn("scoring_threshold", F.lit(float(cutoff))).withColumn("total_predictions", F.col("tp") + F.col("fp"))


def examples(df: DataFrame, rules: Sequence[Rule], key: str, label: str, per_rule: int = 2, seed: int = 42) -> DataFrame:
    """rule_id, rank, key: per rule a few positive rows that it fires on, by a hash of the key."""
    fired = F.filter(F.array(*[F.when(predicate(r), F.lit(r.rule_id)) for r in rules]), lambda x: x.isNotNull())
    rows = df.where(F.col(label) == 1).select(key, F.explode(fired).alias("rule_id"))
    order = Window.partitionBy("rule_id").orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key)
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= per_rule)


def with_excerpts(examples_: DataFrame, texts: DataFrame, key: str, text: str, length: int = 197) -> DataFrame:
    """Examples with an excerpt of their text that fits a table cell; those without a text are left out."""
    return examples_.join(texts.select(key, F.col(text).alias("_t")).where(F.col(text).isNotNull()), key).withColumn("excerpt", table_cell(clip(F.col("_t"), length))).drop("_t")


def report(metrics: DataFrame, rules: Sequence[Rule], examples_: DataFrame) -> DataFrame:
    """line_no, line of a Markdown report: summary, metrics, and a table of rules with their examples."""
    spark = metrics.sparkSession
    head = metrics.select(
        F.posexplode(
            F.array(
                F.lit("# Rule evaluation"),
                *[F.concat(F.lit(f"- {name}: "), fixed(F.col(c), 3)) for name, c in (("precision", "precision"), ("recall", "recall"), ("F1", "f1"))],
                F.format_string("- true positives: %d, false positives: %d, predictions: %d", F.col("tp"), F.col("fp"), F.col("tp") + F.col("fp")),
                F.lit("| # | Feature | Type | Threshold | Precision | Support | Examples |"), F.lit("|---|---|---|---|---|---|---|"),
            )
        ).alias("line_no", "line")
    )
    shown = lambda t: f"{t:.3f}" if isinstance(t, float) else str(t)
    own = spark.createDataFrame([(i + 1, r.rule_id, f"| {i + 1} | {r.feature} | {r.kind} | {shown(r.threshold)} | {r.precision:.3f} | {r.support} | ") for i, r in enumerate(rules)], "n int, rule_id string, start string")
    quoted = examples_.groupBy("rule_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "excerpt"))), lambda x: F.concat(F.lit('"'), x["excerpt"], F.lit('"'))), "<br>").alias("quotes"))
    rows = own.join(quoted, "rule_id", "left").select((F.col("n") + 6).alias("line_no"), F.concat("start", F.coalesce("quotes", F.lit("")), F.lit(" |")).alias("line"))
    return head.unionByName(rows)
