"""Exact stratified split and the checks around it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def split_order(key: Column, seed: int) -> Column:
    """A pseudo-random order of keys that any engine with MD5 can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


#: Hex digits of the order that one pass tells apart, and how many rows a bucket may have to be collected.
_DIGITS, _FEW = 3, 4096


def cut_hashes(df: DataFrame, key: str, label: str, counts: Mapping[int, int], seed: int) -> dict[int, tuple[str, object] | None]:
    """For each label the last (hash, key) among the first counts[label] rows in the order of hash and key; None takes all.

    A histogram of the hashes' first digits, of fixed size, finds the bucket in which the count is reached; the bucket
    is split by its next digits until it holds few rows, and only those are sorted. Labels whose count is 0 are left out.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(label).cast("int").alias("v"), F.col(key).alias("k"), split_order(F.col(key), seed).alias("h"))
    found: dict[int, tuple[str, object] | None] = {}
    open_at = {int(v): ("", int(n)) for v, n in counts.items() if n > 0}  # label -> prefix of the bucket, rows wanted of it
    while open_at:
        deep = len(next(iter(open_at.values()))[0]) + _DIGITS
        here = [(F.col("v") == v) & F.col("h").startswith(prefix) for v, (prefix, _) in open_at.items()]
        buckets = rows.where(reduce(or_, here)).groupBy("v", F.substring("h", 1, deep).alias("b")).agg(F.count("*").alias("n"))
        held: dict[int, list[tuple[str, int]]] = {v: [] for v in open_at}
        for r in buckets.collect():  # 16^3 buckets a label at most
            held[r["v"]].append((r["b"], r["n"]))
        small: dict[int, tuple[str, int]] = {}
        deeper: dict[int, tuple[str, int]] = {}
        for v, (_, wanted) in open_at.items():
            for b, n in sorted(held[v]):
                if wanted <= n:
                    (small if n <= _FEW or deep >= 30 else deeper)[v] = (b, wanted)
                    break
                wanted -= n
            else:
                found[v] = None  # fewer rows than asked for
        if small:
            mine = reduce(or_, [(F.col("v") == v) & F.col("h").startswith(b) for v, (b, _) in small.items()])
            last: dict[int, list] = {v: [] for v in small}
            for r in rows.where(mine).collect():  # few rows a label
                last[r["v"]].append((r["h"], r["k"]))
            found |= {v: sorted(last[v])[wanted - 1] for v, (_, wanted) in small.items()}
        open_at = deeper
    return found


def stratified_split(df: DataFrame, key: str, label: str, counts: Mapping[int, int], seed: int = 42) -> DataFrame:
    """df with split: exactly counts[v] rows of label v are test, all others train.

    Test rows are those up to a hash and key that `cut_hashes` finds, so rows are told apart where they are: nothing is
    joined, sorted or shuffled, whatever the counts. Keys must be distinct; rows with a null key are train. A label with
    fewer rows than asked for is all test.
    """
    order, cuts = split_order(F.col(key), seed), cut_hashes(df, key, label, counts, seed)
    test = F.lit(False)
    for v, cut in cuts.items():
        upto = F.lit(True) if cut is None else (order < cut[0]) | ((order == cut[0]) & (F.col(key) <= F.lit(cut[1])))
        test = test | ((F.col(label).cast("int") == v) & upto)
    return df.withColumn("split", F.when(test & F.col(key).isNotNull(), "test").otherwise("train"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    positives, n = F.count_if(F.col(label) == 1), F.count("*")
    return df.agg(positives.alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.coalesce(F.try_divide(positives, n), F.lit(0.0)).alias("rate"))


def class_weight(df: DataFrame, label: str, target_rate: float = 0.02) -> DataFrame:
    """Weight of positives that makes them target_rate of all: negatives / positives * (1 - r) / r."""
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(positives.alias("positives"), negatives.alias("negatives"), (ratio(negatives, positives) * ((1 - target_rate) / target_rate)).alias("weight"))


def checks(df: DataFrame, rules: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """check, observed, passed: each rule is an aggregate and the range it must lie in, all from one pass."""
    one = df.agg(*[v[0].cast("double").alias(k) for k, v in rules.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("observed"), F.coalesce(F.col(k).between(lo, hi), F.lit(False)).alias("passed")) for k, (_, lo, hi) in rules.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def set_relations(a: DataFrame, b: DataFrame) -> DataFrame:
    """kind, n of the distinct rows of two one-column tables: union, intersect, except, and subset (1 if a is in b)."""
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), a.columns, "full_outer")
    one = both.agg(F.count("*").alias("union"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("intersect"), F.count_if(F.col("_b").isNull()).alias("except"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("union", "intersect", "except")], F.struct(F.lit("subset").alias("kind"), (F.col("except") == 0).cast("long").alias("n")))
    return one.select(F.explode(rows).alias("r")).select("r.*")
