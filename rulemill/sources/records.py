"""JSON records: lines with checks, arrays, and replies of a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shortest text that counts, longest one kept whole, and the bounds of an explanation.
LEAST_CHAIN, MOST_CHAIN, LEAST_TEXT, MOST_TEXT = 10, 5000, 70, 2000
RECORD = "index long, success_label int, causal_cot string"


def line_status(line: Column, text_field: str = "causal_cot", required: tuple[str, ...] = ("index", "success_label", "causal_cot"), least: int = LEAST_CHAIN, most: int = MOST_CHAIN) -> Column:
    """ok, blank, malformed, missing_field, too_short or too_long of one JSON line."""
    parsed = F.try_parse_json(line)
    get = lambda f: F.try_variant_get(parsed, f"$.{f}", "string")
    lacks = F.greatest(*[get(f).isNull().cast("int") for f in required]) == 1
    size = F.length(get(text_field))
    return F.when(F.trim(line) == "", "blank").when(parsed.isNull() | ~line.rlike(r"^\s*\{"), "malformed").when(lacks, "missing_field").when(size < least, "too_short").when(size > most, "too_long").otherwise("ok")


def read_lines(spark: SparkSession, path: str, schema: str = RECORD, strict: bool = True, tolerate: int | None = None) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped. strict: a malformed line or a missing field raises.

    tolerate: that many bad lines are left out, and one more raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    status = line_status(F.col("value"))
    if tolerate is not None:
        found = lines.where(status.isin("malformed", "missing_field")).limit(tolerate + 1).count()
        if found > tolerate:
            raise ValueError(f"over {tolerate} bad records in {path}")
        strict = False
    if strict:
        bad = status.isin("malformed", "missing_field")
        lines = lines.where(F.when(bad, F.raise_error(F.concat(F.lit("bad record: "), F.substring("value", 1, 200))).cast("boolean")).otherwise(True))
    else:
        lines = lines.where(~status.isin("malformed", "missing_field"))
    return lines.where(status != "too_short").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def as_records(df: DataFrame, key: str, features: list[str], label: str, *keep: str) -> DataFrame:
    """row_id, features_json, label and the columns to keep: each row's features as one JSON object."""
    return df.select(F.col(key).alias("row_id"), F.to_json(F.struct(*features), {"ignoreNullFields": "false"}).alias("features_json"), F.col(label).alias("label"), *keep)


def reply_status(reply: Column, expected: Column, text_field: str = "text", least: int = LEAST_TEXT, most: int = MOST_TEXT) -> Column:
    """Checks a model's reply, a JSON array of {index, text}: the first fault, or ok.

    expected is an array of the indices asked for.
    """
    items = F.from_json(reply, f"array<struct<index:bigint,{text_field}:string>>")
    bad = lambda test: F.exists(items, test)
    return (
        F.when(~reply.rlike(r"^\s*\[") | items.isNull(), "not_array")
        .when(F.size(items) != F.size(expected), "wrong_count")
        .when(bad(lambda x: x["index"].isNull() | x[text_field].isNull()), "missing_field")
        .when(bad(lambda x: ~F.array_contains(expected, x["index"])), "bad_index")
        .when(bad(lambda x: F.length(x[text_field]) < least), "too_short")
        .when(bad(lambda x: F.length(x[text_field]) > most), "too_long")
        .otherwise("ok")
    )
