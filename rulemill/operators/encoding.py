"""Feature encoding: kinds, bins, ordinal labels, category codes, layout. Fitted on one table, applied to others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, NumericType, StringType

from ..functions import vocabulary as V
from ..functions.numeric import bin_number
from ..sources.tables import materialize
from .cumulative import quantiles
from .ordering import number_rows


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, distinct: exact counts. Columns are unpivoted and counted in one aggregation with map-side combining."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = df.select(pairs.alias("p")).select("p.*").distinct()
    return values.groupBy("column").agg(F.count("value").alias("distinct"))


def column_kinds(df: DataFrame, distinct: Mapping[str, int], overrides: Mapping[str, str] | None = None, most: int = 10, byte_flags: bool = False) -> dict[str, str]:
    """Kind of each column: an override, else by its type and number of distinct values.

    byte_flags takes all columns of bytes for binary ones, whatever they hold.
    """
    found = {}
    for f in df.schema:
        if overrides and f.name in overrides:
            kind = overrides[f.name]
        elif isinstance(f.dataType, StringType):
            kind = "categorical"
        elif isinstance(f.dataType, BooleanType) or distinct[f.name] <= 2 or (byte_flags and isinstance(f.dataType, ByteType)):
            kind = "binary"
        elif isinstance(f.dataType, NumericType):
            kind = "ordinal" if distinct[f.name] <= most else "continuous"
        else:
            kind = "categorical"
        found[f.name] = kind
    return found


def kinds_by_name(names: Sequence[str], overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Kinds of features of which there is only the name: an override, else by what the name says, else ordinal."""
    says = lambda name, parts: any(p in name.lower() for p in parts)
    by_name = lambda n: "continuous" if says(n, V.CONTINUOUS_NAMES) else "binary" if says(n, V.BINARY_NAMES) else "ordinal"
    return {n: (overrides or {}).get(n) or by_name(n) for n in names}


def kind_by_name(name: Column) -> Column:
    """The kind that the name of a feature says, as in `kinds_by_name`."""
    says = lambda parts: F.greatest(*[F.lower(name).contains(p).cast("int") for p in parts]) == 1
    return F.when(says(V.CONTINUOUS_NAMES), "continuous").when(says(V.BINARY_NAMES), "binary").otherwise("ordinal")


def kind_counts(kinds: DataFrame) -> DataFrame:
    """kind, n of the columns (feature, kind)."""
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def edges_of(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> dict[str, list[float]]:
    """Distinct exact quantiles of each column, the last one replaced by infinity; all columns at once."""
    return {c: [*sorted(set(found))[:-1], float("inf")] for c, found in quantiles(df, columns, shares).items()}


def quantile_edges(df: DataFrame, column: str, shares: Sequence[float] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> list[float]:
    """Distinct exact quantiles of a column, the last one replaced by infinity."""
    return edges_of(df, [column], shares)[column]


def ordinal_label(code: Column, values: Sequence[int]) -> Column:
    """The label of a code on the scale of these values; null for codes off the scale.

    A scale is known by its number of values, and shifted by one if the smallest is 0. Values that a known scale
    doesn't name, and all of other scales, are level_<code>.
    """
    names, shift = V.SCALES.get(len(values), {}), int(bool(values) and min(values) == 0)
    labels = {v: names.get(v + shift, f"level_{v}") for v in values}
    if not labels:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code.cast("int"))


def codes_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, category, code of all columns in one pass: distinct values in order, from 0 in each column.

    Values are numbered by ranges over all columns, so that no task holds a vocabulary; a column's first number is taken off.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns]))
    values = df.select(pairs.alias("p")).select("p.*").where("category is not null").distinct()
    numbered = number_rows(values, "column", "category", name="code")
    firsts = numbered.groupBy("column").agg(F.min("code").alias("_first"))  # a row a column
    return numbered.join(F.broadcast(firsts), "column").select("column", "category", (F.col("code") - F.col("_first")).cast("int").alias("code"))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """category, code: distinct values in order, from 0; numbered by ranges, so that no task holds the vocabulary."""
    return codes_of(df, [column]).select("category", "code")


def apply_codes(df: DataFrame, column: str, codes: DataFrame, unseen: int = 0) -> DataFrame:
    """df with <column>_code; categories the fit hasn't seen get `unseen`. Spark picks the join by the codes' size."""
    named = codes.select(F.col("category").alias(column), F.col("code").alias("_code"))
    return df.join(named, column, "left").withColumn(f"{column}_code", F.coalesce("_code", F.lit(unseen))).drop("_code")


@dataclass(frozen=True)
class Encoding:
    """Fitted state: edges of continuous columns, values of ordinal ones, tables of codes of categorical ones."""

    kinds: dict[str, str]
    edges: dict[str, list[float]]
    levels: dict[str, list[int]]
    codes: dict[str, DataFrame]
    label: str

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Columns to keep, then columns in kind groups, by name within each: raw, bins, ordinals, their labels, binary, codes, text, flags, label.

        Codes are joined, however many there are; Spark broadcasts those that are small.
        """
        of = lambda kind: sorted(c for c, k in self.kinds.items() if k == kind)
        flags = sorted(c for c in df.columns if c.endswith("_missing"))
        continuous, ordinal, categorical = of("continuous"), of("ordinal"), of("categorical")
        coded = df
        for i, c in enumerate(categorical):
            table = self.codes[c].select(F.col("category").alias(f"_category{i}"), F.col("code").alias(f"_code{i}"))
            coded = coded.join(table, F.col(c).cast("string") == F.col(f"_category{i}"), "left")
        return coded.select(
            *keep,
            *[F.col(c).cast("double").alias(c) for c in continuous],
            *[bin_number(F.col(c), self.edges[c]).alias(f"{c}_bin") for c in continuous],
            *[F.col(c).cast("int").alias(c) for c in ordinal],
            *[ordinal_label(F.col(c), self.levels[c]).alias(f"{c}_qual") for c in ordinal],
            *[F.col(c).cast("boolean").alias(c) for c in of("binary")],
            *[F.coalesce(F.col(f"_code{i}"), F.lit(0)).cast("int").alias(c) for i, c in enumerate(categorical)],
            *[F.col(c).cast("string").alias(c) for c in of("text")],
            *flags,
            self.label,
        )


def fit_encoding(df: DataFrame, kinds: Mapping[str, str], label: str, edges: Mapping[str, Sequence[float]] | None = None) -> Encoding:
    """Learns bins (given edges or quintiles), the values of ordinal columns and the codes of categories, each for all columns at once.

    The values of an ordinal column, a byte in cleaned tables, come to the driver; categories don't. What is learned from
    is written first: it takes several passes, and none is to repeat the joins that df is made of.
    """
    learn = [c for c, k in kinds.items() if k in ("ordinal", "categorical") or (k == "continuous" and not (edges and c in edges))]
    df = materialize(df.select(*learn), "encode-input") if learn else df
    continuous = [c for c, k in kinds.items() if k == "continuous"]
    learned = edges_of(df, [c for c in continuous if not (edges and c in edges)])
    cuts = {c: learned[c] if c in learned else list(edges[c]) for c in continuous}
    ordinal = [c for c, k in kinds.items() if k == "ordinal"]
    levels: dict[str, list[int]] = {c: [] for c in ordinal}
    if ordinal:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("int").alias("value")) for c in ordinal]))
        for r in df.select(pairs.alias("p")).select("p.*").where("value is not null").distinct().orderBy("column", "value").collect():
            levels[r["column"]].append(r["value"])
    categorical = [c for c, k in kinds.items() if k == "categorical"]
    every = materialize(codes_of(df, categorical), "codes") if categorical else None
    codes = {c: every.where(F.col("column") == c).select("category", "code") for c in categorical}
    return Encoding(dict(kinds), cuts, levels, codes, label)


def project_selected(df: DataFrame, selected: Sequence[str], label: str) -> DataFrame:
    """The selected columns there are, the missing flags that go with them, and the label."""
    have = set(df.columns)
    return df.select(*[c for c in selected if c in have], *[f"{c}_missing" for c in selected if f"{c}_missing" in have], label)


def bin_profile(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """bin, n, least, most of a binned column."""
    value = F.col(column).cast("double")
    return df.select(bin_number(value, edges).alias("bin"), value.alias("v")).groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
