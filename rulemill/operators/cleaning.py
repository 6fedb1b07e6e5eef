"""Cleaning of raw text tables: null tokens, coercion, range checks, flags, imputation, casts.

Statistics of all columns come from one aggregation and are applied as literals, so cleaning is one pass to fit and
one to apply, without a shuffle of rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import number
from ..spec import FeatureSpec
from ..sources.tables import materialize
from .cumulative import quantiles

NUMERIC = ("continuous", "ordinal")
#: How missing values of each kind are filled: median, mean, mode, zero or empty_string; and the types that casts give.
IMPUTATION = {"continuous": "median", "ordinal": "median", "binary": "mode", "categorical": "empty_string"}


def standardise_nulls(df: DataFrame) -> DataFrame:
    return df.select(*[T.null_tokens(F.col(c)).alias(c) for c in df.columns])


def coerced(spec: FeatureSpec) -> Column:
    """The column as a number if its kind is numeric, values below the smallest valid one as null."""
    c = F.col(spec.name)
    if spec.kind not in NUMERIC:
        return c.alias(spec.name)
    value = number(c)
    return (value if spec.min_valid is None else F.when(value >= spec.min_valid, value)).alias(spec.name)


def coerce(df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    return df.select(*[coerced(s) for s in specs])


def invalid_counts(df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """column, replaced, kept of the columns with a smallest valid value, in one pass."""
    checked = [s for s in specs if s.min_valid is not None]
    value = {s.name: number(F.col(s.name)) for s in checked}
    one = df.agg(*[F.struct(F.count_if(value[s.name] < s.min_valid).alias("replaced"), F.count_if(value[s.name] >= s.min_valid).alias("kept")).alias(s.name) for s in checked])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s.name).alias("column"), F.col(f"{s.name}.replaced"), F.col(f"{s.name}.kept")) for s in checked])).alias("r")).select("r.*")


def missing_flags(df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """df with <column>_missing for every column that doesn't identify rows."""
    return df.select("*", *[F.col(s.name).isNull().alias(f"{s.name}_missing") for s in specs if not s.identifier])


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, nulls, rate: one aggregation, then one row a column."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.coalesce(F.try_divide(F.col(c), F.col("_n")), F.lit(0.0)).alias("rate")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@dataclass(frozen=True)
class CleaningModel:
    """Values to impute, learned once."""

    specs: tuple[FeatureSpec, ...]
    values: dict[str, float | str]
    casts: Mapping[str, str] = field(default_factory=dict)

    def impute(self, df: DataFrame) -> DataFrame:
        filled = {s.name: F.coalesce(F.col(s.name), F.lit(self.values[s.name])).alias(s.name) for s in self.specs if s.name in self.values}
        return df.select(*[filled.get(c, F.col(c)) for c in df.columns])

    def cast(self, df: DataFrame) -> DataFrame:
        kinds = {s.name: s.kind for s in self.specs}
        return df.select(*[(typed(F.col(c), kinds[c]).cast(self.casts[kinds[c]]) if kinds[c] in self.casts else typed(F.col(c), kinds[c])).alias(c) if c in kinds else F.col(c) for c in df.columns])


def typed(column: Column, kind: str) -> Column:
    """float for continuous, truncated byte for ordinal, boolean for binary (nonzero number), text for categorical."""
    if kind == "continuous":
        return column.cast("float")
    if kind == "ordinal":
        return F.coalesce(column.cast("double"), F.lit(0.0)).cast("int").cast("byte")
    if kind == "binary":
        return F.coalesce(number(column.cast("string")), F.lit(0.0)) != 0
    return column.cast("string")


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value of each column, the smallest on ties, nulls left out; a column without values lacks.

    Values are counted before they are ranked, so that no task holds the distinct values of a column.
    """
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).where("p.value is not null").groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    return {r["column"]: r["b"]["value"] for r in best.collect()}  # a row a column


def fit(df: DataFrame, specs: list[FeatureSpec], imputation: Mapping[str, str] | None = None, casts: Mapping[str, str] | None = None) -> CleaningModel:
    """What fills missing values, as `IMPUTATION` says for each kind or as asked for; casts may name other types.

    Medians are exact, modes are the smallest on ties; a column without values gets 0, or an empty text if categorical.
    """
    chosen = IMPUTATION | dict(imputation or {})
    named = {s.name: s.kind for s in specs if not s.identifier}
    how = {c: chosen[k] for c, k in named.items()}
    if wrong := sorted({f"{h} of {named[c]}" for c, h in how.items() if h not in ("median", "mean", "mode", "zero", "empty_string") or (h in ("median", "mean") and named[c] not in NUMERIC) or (h == "empty_string" and named[c] in NUMERIC)}):
        raise ValueError("imputation can't be " + ", ".join(wrong))
    of = lambda h: [c for c, x in how.items() if x == h]
    values: dict[str, float | str] = {c: 0.0 if named[c] in NUMERIC else "" if h == "empty_string" or named[c] == "categorical" else "0" for c, h in how.items()}
    values |= {c: q[0] for c, q in quantiles(df, of("median"), [0.5]).items() if q}
    if of("mean"):
        values |= {c: v for c, v in df.agg(*[F.avg(c).alias(c) for c in of("mean")]).first().asDict().items() if v is not None}
    values |= {c: float(v) if named[c] in NUMERIC else v for c, v in modes(df, of("mode")).items()}
    values |= {c: 0.0 if named[c] in NUMERIC else "0" for c in of("zero")}
    return CleaningModel(tuple(specs), values, dict(casts or {}))


def clean(df: DataFrame, specs: list[FeatureSpec], imputation: Mapping[str, str] | None = None, casts: Mapping[str, str] | None = None) -> tuple[DataFrame, CleaningModel]:
    """All steps in order; returns the clean table and what was learned.

    The coerced table is written once, so that what is learned and the result read that and not the raw text again.
    """
    tidy = materialize(missing_flags(coerce(standardise_nulls(df), specs), specs), "coerced")
    model = fit(tidy, specs, imputation, casts)
    return model.cast(model.impute(tidy)), model
