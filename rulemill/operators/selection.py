"""Feature ranking by gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import boosting
from .encoding import codes_of
from .splitting import class_weight


def coded(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """df with categories as the numbers of their places in order, null for nulls; Spark picks the joins by the codes' size."""
    if not categorical:
        return df
    every = materialize(codes_of(df, categorical), "codes")
    for c in categorical:
        codes = every.where(F.col("column") == c).select(F.col("category").alias("_category"), F.col("code").alias("_code"))
        df = df.join(codes, F.col(c).cast("string") == F.col("_category"), "left").withColumn(c, F.col("_code")).drop("_category", "_code")
    return df


def learned(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, rounds: int = 100, depth: int = 4, rate: float = 0.1, share: float = 0.8, target_rate: float | None = None, seed: int = 42) -> tuple[DataFrame, boosting.Boosted]:
    """(rows as the trees see them, the trees). Positives are weighted if asked for; each tree draws a share of the rows and of the columns."""
    names = [*numeric, *categorical]
    weight = class_weight(df, label, target_rate).first()["weight"] if target_rate else None
    rows = coded(df.select(*names, label), categorical).withColumn("_w", F.when(F.col(label) == 1, F.lit(float(weight if weight is not None else 1.0))).otherwise(1.0))
    return rows, boosting.fit(rows, names, label, "_w", rounds, depth, rate, share, share, seed=seed)


def ranked(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, top: int = 25, rounds: int = 100, depth: int = 4, rate: float = 0.1, share: float = 0.8, target_rate: float | None = None, seed: int = 42, measure: str = "contribution") -> tuple[DataFrame, DataFrame]:
    """(feature, rank, importance) of the top features, and (rows, right, accuracy) of the trees on their own rows.

    Positives are weighted if asked for. measure: contribution (mean absolute Shapley value of the margin) or gain (of
    all splits). Each tree draws a share of the rows and of the columns.
    """
    rows, model = learned(df, numeric, categorical, label, rounds, depth, rate, share, target_rate, seed)
    found = boosting.importance_by_gain(model) if measure == "gain" else boosting.mean_contributions(rows, model)
    first = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:top]
    return df.sparkSession.createDataFrame([(f, i + 1, float(g)) for i, (f, g) in enumerate(first)], "feature string, rank int, importance double"), boosting.accuracy(rows, model, label)


def training_accuracy(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, **how: object) -> DataFrame:
    """rows, right, accuracy of the trees on their own rows, without ranking what they learned from; see `learned`."""
    return boosting.accuracy(*learned(df, numeric, categorical, label, **how), label)


def importance(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, **how: object) -> DataFrame:
    """feature, rank, importance of the top features; see `ranked`."""
    return ranked(df, numeric, categorical, label, **how)[0]


def root_split(df: DataFrame, inputs: Sequence[str], label: str, bins: int = 16) -> DataFrame:
    """feature, cut, missing_left, gain, left_hessian of the first split of a first tree over all rows and inputs; no row without one."""
    model = boosting.fit(df, inputs, label, rounds=1, depth=1, rows_share=2.0, columns_share=1.0, bins=bins)
    tree = model.trees[0]
    rows = [(inputs[tree.feature[0]], float(model.cuts[tree.feature[0]][tree.upto[0] - 1]), bool(tree.missing_left[0]), float(tree.gain[0]), float(tree.cover[tree.left[0]]))] if tree.feature[0] >= 0 else []
    return df.sparkSession.createDataFrame(rows, "feature string, cut double, missing_left boolean, gain double, left_hessian double")
