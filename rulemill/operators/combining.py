"""Combination of rules into one decision: scores with a cut-off, cumulative OR, greedy cover, tiers, votes.

Rows are reduced first: to the first rule that fires, to the set of rules that fire, or to the distinct scores. What
comes to the driver is a row a rule, whatever the number of rows or of sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numeric import f1, left_sum, precision, ratio, recall
from ..sources.tables import materialize
from ..spec import Rule
from .rules import predicate, sorted_rules, usable

#: Rules told apart by the bits of one long; a set of rules is an array of such longs.
_WORD = 62


def contribution(rule: Rule, method: str = "precision_weighted") -> float:
    return {"precision_weighted": rule.precision, "confidence_weighted": rule.precision * (rule.weight / 100), "simple_sum": 0.05}[method]


def score(rules: Sequence[Rule], method: str = "precision_weighted") -> Column:
    """The sum of what the rules that fire contribute, added in the order of the rules."""
    return left_sum([F.when(predicate(r), F.lit(contribution(r, method))).otherwise(F.lit(0.0)) for r in rules])


def score_histogram(df: DataFrame, rules: Sequence[Rule], label: str, method: str = "precision_weighted") -> DataFrame:
    """score, positives, n of each distinct score: at most 2 ** rules rows, in practice few."""
    return df.select(score(rules, method).alias("score"), F.col(label).alias("_y")).groupBy("score").agg(F.count_if(F.col("_y") == 1).alias("positives"), F.count("*").alias("n"))


def cutoff_sweep(histogram: DataFrame, absolute: Sequence[float] = tuple(V.ABSOLUTE_CUTOFFS)) -> DataFrame:
    """k, cutoff, tp, fp, fn, precision, recall, f1 of `score >= cutoff`: scores, midpoints, scores x 1.1, fixed ones.

    histogram: k, score, positives, n. Cut-offs are sorted among the scores from the top, and one running sum gives the
    counts of all. A k has at most 2 ** k scores, and no more than there are rows.
    """
    following = F.lead("score").over(Window.partitionBy("k").orderBy("score"))
    own = histogram.where("score > 0").withColumn("_next", following)
    between = F.when(F.col("_next").isNotNull(), F.array(F.col("score"), (F.col("score") + F.col("_next")) / 2, F.col("score") * F.lit(1.1))).otherwise(F.array("score"))
    fixed = histogram.select("k").distinct().select("k", F.explode(F.array(*[F.lit(float(a)) for a in absolute])).alias("cutoff"))
    cuts = own.select("k", F.explode(between).alias("cutoff")).unionByName(fixed).where("cutoff > 0").distinct()
    none = F.lit(0).cast("long")
    events = histogram.select("k", F.col("score").alias("at"), F.lit(0).alias("cut"), "positives", "n").unionByName(cuts.select("k", F.col("cutoff").alias("at"), F.lit(1).alias("cut"), none.alias("positives"), none.alias("n")))
    upto = Window.partitionBy("k").orderBy(F.desc("at"), "cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = events.select("k", "at", "cut", F.sum("positives").over(upto).alias("tp"), F.sum("n").over(upto).alias("_n"), F.sum("positives").over(Window.partitionBy("k")).alias("_all"))
    counted = run.where("cut = 1 and tp > 0").select("k", F.col("at").alias("cutoff"), "tp", (F.col("_n") - F.col("tp")).alias("fp"), (F.col("_all") - F.col("tp")).alias("fn"))
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return counted.select("k", "cutoff", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def weighted_scoring(df: DataFrame, rules: Sequence[Rule], label: str, prefixes: Sequence[int] = tuple(V.PREFIXES), min_precision: float = V.MIN_PRECISION, method: str = "precision_weighted") -> DataFrame:
    """The sweeps of all prefixes of the rules, each with k; the rows are read once.

    Rows are counted by the set of rules that fire, of those that some prefix holds, and every prefix is scored on those
    sets.
    """
    sizes = sorted({min(k, len(rules)) for k in prefixes})
    looked = list(rules[: sizes[-1]]) if sizes else []
    sets = fired_sets(df, looked, label)
    terms = [F.when(holds(i), F.lit(contribution(r, method))).otherwise(F.lit(0.0)) for i, r in enumerate(looked)]
    scored = sets.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), left_sum(terms[:k]).alias("score")) for k in sizes])).alias("s"), "positives", "n")
    histogram = materialize(scored.groupBy("s.k", "s.score").agg(F.sum("positives").alias("positives"), F.sum("n").alias("n")), "score-histogram")
    return cutoff_sweep(histogram).where(F.col("precision") >= min_precision)


def best_cutoff(sweep: DataFrame) -> DataFrame:
    """The row with the highest F1; ties to the shortest prefix, then the smallest cut-off."""
    return sweep.orderBy(F.desc("f1"), "k", "cutoff").limit(1)


def _first_counts(df: DataFrame, rules: Sequence[Rule], label: str) -> dict[int, tuple[int, int]]:
    """Place of the first rule that fires (their number if none does) -> positives, negatives: at most a row a rule."""
    first = F.coalesce(*[F.when(predicate(r), F.lit(i)) for i, r in enumerate(rules)], F.lit(len(rules)))
    counts = df.select(first.alias("pos"), F.col(label).alias("_y")).groupBy("pos").agg(F.count_if(F.col("_y") == 1).alias("p"), F.count_if(F.col("_y") == 0).alias("n"))
    return {r["pos"]: (r["p"], r["n"]) for r in counts.collect()}


def or_cumulative(df: DataFrame, rules: Sequence[Rule], label: str) -> DataFrame:
    """pos, rule_id, tp, fp, fn, precision, recall, f1 after each rule is added by OR: one pass and one running sum."""
    first = F.coalesce(*[F.when(predicate(r), F.lit(i)) for i, r in enumerate(rules)], F.lit(len(rules)))
    counts = df.select(first.alias("pos"), F.col(label).alias("_y")).groupBy("pos").agg(F.count_if(F.col("_y") == 1).alias("p"), F.count_if(F.col("_y") == 0).alias("n"))
    names = df.sparkSession.createDataFrame([(i, r.rule_id) for i, r in enumerate(rules)] + [(len(rules), None)], "pos int, rule_id string")
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = names.join(counts, "pos", "left").select("pos", "rule_id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    every = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = full.select("pos", "rule_id", F.sum("p").over(upto).alias("tp"), F.sum("n").over(upto).alias("fp"), F.sum("p").over(every).alias("_all")).where("rule_id is not null")
    run = run.withColumn("fn", F.col("_all") - F.col("tp")).drop("_all")
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return run.select("pos", "rule_id", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def fired_sets(df: DataFrame, rules: Sequence[Rule], label: str) -> DataFrame:
    """fired, positives, n: rows by the set of rules that fire, as the bits of an array of longs."""
    words = []
    for first in range(0, max(1, len(rules)), _WORD):
        words.append(sum((F.when(predicate(r), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules[first : first + _WORD])), F.lit(0).cast("long")))
    return df.select(F.array(*words).alias("fired"), F.col(label).alias("_y")).groupBy("fired").agg(F.count_if(F.col("_y") == 1).alias("positives"), F.count("*").alias("n"))


def holds(place: int) -> Column:
    """Whether a set of `fired_sets` holds the rule at a place."""
    return F.get("fired", F.lit(place // _WORD)).bitwiseAND(F.lit(1 << place % _WORD).cast("long")) != 0


def any_of(rules: Sequence[Rule]) -> Column:
    """Whether a row meets any of the rules."""
    return reduce(lambda a, b: a | b, map(predicate, rules), F.lit(False))


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def greedy_cover(df: DataFrame, rules: Sequence[Rule], label: str, target_recall: float = V.TARGET_RECALL) -> list[tuple[int, str, int, int]]:
    """(pos, rule_id, tp, fp): rules in order that reach positives none before has, until the recall is reached.

    A rule that is left out adds no positives, so a rule reaches new ones if it is the first to fire on any.
    """
    counts = _first_counts(df, rules, label)
    total, covered, chosen = sum(p for p, _ in counts.values()), 0, []
    for i, r in enumerate(rules):
        new = counts.get(i, (0, 0))[0]
        covered += new
        if new:
            chosen.append(r)
        if total and covered / total >= target_recall:
            break
    if not chosen:
        return []
    own, tp, fp, out = _first_counts(df, chosen, label), 0, 0, []
    for i, r in enumerate(chosen):
        p, n = own.get(i, (0, 0))
        tp, fp = tp + p, fp + n
        out.append((i, r.rule_id, tp, fp))
    return out


def hierarchical(df: DataFrame, rules: Sequence[Rule], label: str, tiers: Sequence[tuple[float, int]] = tuple(V.TIERS), min_precision: float = V.MIN_PRECISION, target_recall: float = V.TARGET_RECALL) -> list[tuple[int, str, int, int]]:
    """(pos, rule_id, tp, fp): rules tier by tier, each if the precision of all together stays high enough.

    A rule comes up again in every later tier, and is listed each time it is admitted. Recall counts true positives.
    Each step depends on the one before, so each is one aggregation of the sets of the rules that tiers look at.
    """
    looked = {i for least, most in tiers for i in [i for i, r in enumerate(rules) if r.precision >= least][:most]}
    used = [r for i, r in enumerate(rules) if i in looked]
    sets = materialize(fired_sets(df, used, label), "fired-sets")
    total = sets.agg(F.coalesce(F.sum("positives"), F.lit(0))).first()[0]
    held: dict[frozenset[int], tuple[int, int]] = {frozenset(): (0, 0)}

    def counts(places: frozenset[int]) -> tuple[int, int]:
        if places not in held:
            met = reduce(lambda a, b: a | b, [holds(i) for i in sorted(places)])
            row = sets.where(met).agg(F.coalesce(F.sum("positives"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
            held[places] = (row[0], row[1] - row[0])
        return held[places]

    taken, out = frozenset(), []
    for least, most in tiers:
        for i, r in [(i, r) for i, r in enumerate(used) if r.precision >= least][:most]:
            tp, fp = counts(taken | {i})
            if tp + fp and tp / (tp + fp) >= min_precision:
                taken |= {i}
                out.append((len(out), r.rule_id, tp, fp))
        if total and counts(taken)[0] / total >= target_recall:
            break
    return out


def ensemble_votes(df: DataFrame, rules: Sequence[Rule], label: str, top: int = 5, most: int = V.ENSEMBLE_RULES, min_precision: float = V.MIN_PRECISION) -> dict[str, Column]:
    """Conditions on rows: three sub-models and their majority, unanimous and weighted votes.

    high_precision: any of the `top` most precise rules; high_recall: any that the greedy cover takes of the first
    `most`; balanced: any of the prefix, of `most` at most, with the highest F1 among those precise enough (none if none
    is).
    """
    by_precision = sorted(rules, key=lambda r: -r.precision)[:top]
    chosen = {r for _, r, _, _ in greedy_cover(df, rules[:most], label)}
    best = or_cumulative(df, rules[:most], label).where((F.col("precision") >= min_precision) & (F.col("f1") > 0)).orderBy(F.desc("f1"), "pos").limit(1).collect() if rules else []
    hit = {"high_precision": any_of(by_precision), "high_recall": any_of([r for r in rules[:most] if r.rule_id in chosen]), "balanced": any_of(rules[: best[0]["pos"] + 1] if best else [])}
    votes = sum((h.cast("int") for h in hit.values()), F.lit(0))
    return hit | {"majority": votes >= 2, "unanimous": votes == 3, "weighted": votes / 3.0 >= 0.5}


def ensemble(df: DataFrame, rules: Sequence[Rule], label: str, top: int = 5) -> DataFrame:
    """strategy, predicted, tp of the sub-models and their votes, from one aggregation."""
    hit = ensemble_votes(df, rules, label, top)
    y = F.col(label) == 1
    one = df.agg(*[F.struct(F.count_if(h).alias("predicted"), F.count_if(h & y).alias("tp")).alias(k) for k, h in hit.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(f"{k}.predicted"), F.col(f"{k}.tp")) for k in hit])).alias("r")).select("r.*")


def contributing(df: DataFrame, rules: Sequence[Rule], decided: Column, label: str, enough: float = V.ENSEMBLE_COVER) -> list[Rule]:
    """Rules in order that fire on decided rows which none before does, until all but a small share is covered."""
    counts = {i: p + n for i, (p, n) in _first_counts(df.where(decided), rules, label).items()}
    total = left = sum(counts.values())
    out = []
    for i, r in enumerate(rules):
        if counts.get(i, 0):
            out.append(r)
            left -= counts[i]
            if left < enough * total:
                break
    return out


_RECORD = "rule_index long, rule_id string, feature string, feature_type string, outcome string, weight long, threshold_num double, threshold_str string, rule_precision double, rule_support long"
_COMBINED = "scoring_threshold double, combined_precision double, combined_support long, combined_recall double, combined_f1 double, combined_false_positives double"


def _own(i: int, r: Rule) -> tuple:
    t = r.threshold
    return (i, r.rule_id, r.feature, r.kind, r.outcome, r.weight, None if isinstance(t, (str, bool)) or t is None else float(t), str(t).lower() if isinstance(t, bool) else t if isinstance(t, str) else None, r.precision, r.support)


def combined_records(spark, rules: Sequence[Rule], counts: Sequence[tuple[int, int, int]]) -> DataFrame:
    """One row a rule with its own figures and those of a combination: its (tp, fp, fn), one for each rule."""
    rows = []
    for i, (r, (tp, fp, fn)) in enumerate(zip(rules, counts, strict=True)):
        p, q = _share(tp, tp + fp), _share(tp, tp + fn)
        rows.append((*_own(i, r), None, p, tp, q, _share(2 * p * q, p + q), float(fp)))
    return spark.createDataFrame(rows, f"{_RECORD}, {_COMBINED}")


STRATEGIES = ("weighted_scoring", "hierarchical", "ensemble", "simple_or")


def combine(df: DataFrame, rules: Sequence[Rule], label: str, strategy: str = "weighted_scoring", order: str = "weight_desc", method: str = "precision_weighted", voting: str = "majority", least_precision: float = V.LEAST_RULE_PRECISION, most: int | None = None, stop_at: float | None = None) -> DataFrame:
    """Calibrated records of the rules that a strategy combines, in the order in which it does.

    Rules without a threshold are left out, and those below least_precision unless all are. most and stop_at bound
    simple_or: the rules it looks at, and the precision at which it stops.
    """
    spark, found = df.sparkSession, sorted_rules(usable(rules, least_precision), order)
    if strategy == "weighted_scoring":
        return calibrated_rules(weighted_scoring(df, found, label, method=method), found)
    if strategy == "simple_or":
        rows = or_cumulative(df, found[:most], label).orderBy("pos").collect() if found else []  # a row a rule
        end = next((r["pos"] + 1 for r in rows if stop_at is not None and r["precision"] >= stop_at), len(rows))
        return combined_records(spark, found[:end], [(r["tp"], r["fp"], r["fn"]) for r in rows[:end]])
    if strategy == "hierarchical":
        steps = hierarchical(df, found, label)
        by_id = {r.rule_id: r for r in found}
        chosen, decided = [by_id[r] for _, r, _, _ in steps], any_of([by_id[r] for r in dict.fromkeys(r for _, r, _, _ in steps)])
    elif strategy == "ensemble":
        decided = ensemble_votes(df, found, label)[voting]
        chosen = contributing(df, found, decided, label)
    else:
        raise ValueError(f"unknown strategy {strategy!r}, not one of {', '.join(STRATEGIES)}")
    y = F.col(label) == 1
    one = df.select(decided.alias("_d"), y.alias("_y")).agg(F.count_if(F.col("_d") & F.col("_y")), F.count_if(F.col("_d") & ~F.col("_y")), F.count_if(~F.col("_d") & F.col("_y"))).first()
    return combined_records(spark, chosen, [tuple(one)] * len(chosen))


def calibrated_rules(sweep: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row a rule of the best prefix, with its own figures and those of the combination."""
    own = sweep.sparkSession.createDataFrame([_own(i, r) for i, r in enumerate(rules)], _RECORD)
    best = best_cutoff(sweep).select("k", F.col("cutoff").alias("scoring_threshold"), F.col("precision").alias("combined_precision"), F.col("tp").alias("combined_support"), F.col("recall").alias("combined_recall"), F.col("f1").alias("combined_f1"))
    found = own.join(F.broadcast(best), F.col("rule_index") < F.col("k")).drop("k")
    return found.withColumn("combined_false_positives", ratio(F.col("combined_support"), F.col("combined_precision")) - F.col("combined_support"))
