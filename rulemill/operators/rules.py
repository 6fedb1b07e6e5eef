"""Rules as data: one predicate factory, candidate thresholds, threshold scans, best thresholds.

A scan never tests candidates against rows. It counts rows by value once, and a running sum from the largest value
down gives the counts of every threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import precision, ratio
from ..spec import Rule
from .cumulative import quantiles, ranged, sums_over


def predicate(rule: Rule) -> Column:
    """Whether a row meets a rule; never null. Used by calibration and evaluation alike.

    continuous, ordinal: at least the threshold; ordinal with a text or boolean threshold, and categorical: equal to
    it; binary: true (or 1), whatever the threshold.
    """
    c = F.col(rule.feature)
    if rule.kind == "binary":
        met = c.cast("string").isin("true", "1", "1.0")
    elif rule.kind == "categorical" or isinstance(rule.threshold, (str, bool)):
        met = c.cast("string") == F.lit(str(rule.threshold).lower() if isinstance(rule.threshold, bool) else rule.threshold)
    else:
        value = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        met = value >= float(rule.threshold)
    return F.coalesce(met, F.lit(False))


def evaluate_each(df: DataFrame, rules: Sequence[Rule], label: str) -> DataFrame:
    """rule_id, tp, fp, precision, fired of every rule, from one pass."""
    one = df.select(F.col(label).alias("_y"), *[predicate(r).alias(r.rule_id) for r in rules]).agg(
        *[F.struct(F.count_if(F.col(r.rule_id) & (F.col("_y") == 1)).alias("tp"), F.count_if(F.col(r.rule_id) & (F.col("_y") == 0)).alias("fp"), F.count_if(F.col(r.rule_id)).alias("fired")).alias(r.rule_id) for r in rules]
    )
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"{r.rule_id}.tp"), F.col(f"{r.rule_id}.fp"), F.col(f"{r.rule_id}.fired")) for r in rules])
    found = one.select(F.explode(rows).alias("r")).select("r.*")
    return found.select("rule_id", "tp", "fp", precision(F.col("tp"), F.col("fp")).alias("precision"), "fired")


def value_counts(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, value, pos, neg: the rows of each distinct value of numeric features, unpivoted before one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    long = df.select(F.col(label).alias("_y"), pairs.alias("p")).where("p.value is not null")
    return long.groupBy("p.feature", "p.value").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))


def threshold_scan(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, threshold, tp, fp, precision for `feature >= threshold`, for every distinct value."""
    return suffix_sums(ranged(value_counts(df, features, label), "feature", "value", descending=True)).drop("from_top")


def suffix_sums(placed: DataFrame) -> DataFrame:
    """The counts of each threshold and its place from the top: running sums from the largest value down."""
    run = sums_over(placed.withColumn("one", F.lit(1).cast("long")), "feature", "value", ["pos", "neg", "one"], descending=True)
    tp, fp = F.col("pos_run"), F.col("neg_run")
    return run.select("feature", F.col("value").alias("threshold"), tp.alias("tp"), fp.alias("fp"), precision(tp, fp).alias("precision"), F.col("one_run").alias("from_top"))


def candidates(df: DataFrame, kinds: dict[str, str], label: str, most: int = 100, levels: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """feature, pos, threshold, tp, fp: thresholds to try of numeric features, with their counts.

    continuous: all distinct values, or `most` evenly spaced ones of them (positions k * ((n - 1) / (most - 1)) cut to
    whole numbers, the last one exact); ordinal: those of levels that occur, or all values if none does.
    """
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("feature"))
    is_level = lambda c: F.col(c).isin([float(v) for v in levels])
    counts = ranged(value_counts(df, list(kinds), label), "feature", "value", descending=True)
    facts = counts.groupBy("feature").agg(F.count("*").alias("_n"), F.max(is_level("value")).alias("_any"))  # a row a feature
    scan = suffix_sums(counts).withColumn("_level", is_level("threshold")).join(F.broadcast(facts), "feature").withColumn("_i", F.col("_n") - F.col("from_top"))
    last = F.col("_n") - 1
    # a place is that of k if k lands on it; only three k come near
    step = last / F.lit(float(most - 1))
    near = F.floor(F.col("_i") / step).cast("long")
    lands = [((near + d) * step).cast("long").eqNullSafe(F.col("_i")) & (near + d).between(0, most - 2) for d in (-1, 0, 1)]
    spaced = (F.col("_n") <= most) | (F.col("_i") == last) | lands[0] | lands[1] | lands[2]
    kept = scan.where(F.when(kind == "continuous", spaced).otherwise(F.col("_level") | ~F.col("_any")))
    by = Window.partitionBy("feature").orderBy("threshold")
    return kept.select("feature", (F.row_number().over(by) - 1).cast("int").alias("pos"), "threshold", "tp", "fp", "precision")


def percentile_candidates(df: DataFrame, features: Sequence[str], shares: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95)) -> DataFrame:
    """feature, pos, threshold: exact percentiles, repeats left out."""
    rows = [(c, i, t) for c, ts in quantiles(df, features, shares).items() for i, t in enumerate(sorted(set(ts)))]
    return df.sparkSession.createDataFrame(rows, "feature string, pos int, threshold double")


TIES = {"highest_support": (F.desc, "tp"), "lowest_threshold": (F.asc, "threshold"), "highest_threshold": (F.desc, "threshold")}


def best_thresholds(scan: DataFrame, min_support: int = 1, ties: str = "highest_support") -> DataFrame:
    """The row of each feature with the highest precision; ties as asked, then the earliest candidate."""
    then, column = TIES[ties]
    order = Window.partitionBy("feature").orderBy(F.desc("precision"), then(column), "pos")
    return scan.where(F.col("tp") >= min_support).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def filtered(best: DataFrame, min_precision: float) -> DataFrame:
    """Features that reach the precision; all of them if none does."""
    flagged = best.withColumn("_ok", F.col("precision") >= min_precision)
    some = flagged.agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("_some"))
    return flagged.join(F.broadcast(some)).where(F.col("_ok") | ~F.col("_some")).drop("_ok", "_some")


def usable(rules: Sequence[Rule], least_precision: float) -> list[Rule]:
    """Rules with a threshold that are precise enough; all that have one if none is."""
    valid = [r for r in rules if r.threshold is not None]
    return [r for r in valid if r.precision >= least_precision] or valid


def sorted_rules(rules: Sequence[Rule], by: str = "weight_desc", weight_share: float = 0.7) -> list[Rule]:
    """Rules in the order in which they are combined; equal ones stay as they are."""
    top = max((r.weight for r in rules), default=1) or 1
    keys = {"weight_desc": lambda r: r.weight, "precision_desc": lambda r: r.precision, "combined": lambda r: weight_share * (r.weight / top) + (1 - weight_share) * r.precision}
    return sorted(rules, key=keys[by], reverse=True)


def percentile_scan(df: DataFrame, features: Sequence[str], label: str, shares: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95)) -> DataFrame:
    """feature, pos, threshold, tp, fp, precision of the percentiles of each feature, all counted in one pass."""
    tried = [(c, i, t) for c, ts in quantiles(df, features, shares).items() for i, t in enumerate(sorted(set(ts)))]
    meets = lambda c, t, y: F.count_if((F.col(c).cast("double") >= F.lit(t)) & ~F.isnan(F.col(c).cast("double")) & (F.col(label) == y))
    counted = df.agg(*[F.struct(meets(c, t, 1).alias("tp"), meets(c, t, 0).alias("fp")).alias(f"t{n}") for n, (c, _, t) in enumerate(tried)]).first() if tried else ()
    rows = [(c, i, t, counted[n]["tp"], counted[n]["fp"]) for n, (c, i, t) in enumerate(tried)]
    scan = df.sparkSession.createDataFrame(rows, "feature string, pos int, threshold double, tp long, fp long")
    return scan.withColumn("precision", precision(F.col("tp"), F.col("fp")))


def calibrate(df: DataFrame, rules: Sequence[Rule], label: str, min_support: int = 1, ties: str = "highest_support", tried: str = "unique_values", levels: Sequence[int] = (1, 2, 3, 4, 5), most: int = 100) -> list[Rule]:
    """Rules with their best thresholds, precision and support: one scan for all numeric ones, one for the others.

    ties: see `TIES`. tried: which thresholds continuous features try, unique_values (`most` of them) or percentiles.
    levels: what ordinal features try.

    What comes to the driver is a row a rule, and for categories the best value of each.
    """
    numeric = {r.feature: r.kind for r in rules if r.kind in ("continuous", "ordinal")}
    if tried not in ("unique_values", "percentiles"):
        raise ValueError(f"unknown candidates {tried!r}")
    scans = []
    if tried == "percentiles" and (continuous := [c for c, k in numeric.items() if k == "continuous"]):
        scans.append(percentile_scan(df, continuous, label))
    if left := {c: k for c, k in numeric.items() if k != "continuous" or tried == "unique_values"}:
        scans.append(candidates(df, left, label, most, levels))
    best = {r["feature"]: r for scan in scans for r in best_thresholds(scan, min_support, ties).collect()}
    out = []
    named = sorted({r.feature for r in rules if r.kind == "categorical"})
    counts = {}
    if named:  # one pass for all categories
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in named]))
        table = df.select(pairs.alias("x"), F.col(label).alias("y")).where("x.v is not null").groupBy("x.feature", "x.v").agg(F.count_if(F.col("y") == 1).alias("tp"), F.count_if(F.col("y") == 0).alias("fp"))
        rated = table.where(F.col("tp") >= min_support).withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        best_of = F.min(F.struct((-F.col("p")).alias("p"), (-F.col("tp")).alias("tp"), "v"))
        counts = {r["feature"]: r["b"] for r in rated.groupBy("feature").agg(best_of.alias("b")).collect()}
    flags = [r for r in rules if r.kind == "binary"]
    fired = {r["rule_id"]: r for r in evaluate_each(df, flags, label).collect()} if flags else {}
    for r in rules:
        if r.kind in ("continuous", "ordinal") and r.feature in best:
            b = best[r.feature]
            out.append(Rule(r.rule_id, r.feature, r.kind, r.weight, b["threshold"], b["precision"], b["tp"], r.outcome, r.mechanisms))
        elif r.kind == "categorical" and r.feature in counts:
            b = counts[r.feature]
            out.append(Rule(r.rule_id, r.feature, r.kind, r.weight, b["v"], -b["p"], -b["tp"], r.outcome, r.mechanisms))
        elif r.kind == "binary" and fired[r.rule_id]["tp"] >= min_support:
            b = fired[r.rule_id]
            out.append(Rule(r.rule_id, r.feature, r.kind, r.weight, True, b["precision"], b["tp"], r.outcome, r.mechanisms))
    return out
