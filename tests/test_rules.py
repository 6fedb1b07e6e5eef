import random

import pytest
from pyspark.sql import functions as F

from rulemill.operators import combining, evaluation, rules
from rulemill.spec import Rule


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = [(i, round(rng.random() * 300) / 3, rng.randint(0, 5), rng.random() < 0.4, rng.choice("abc"), int(rng.random() < 0.3)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, x double, o int, f boolean, c string, y int").cache()


RULES = [Rule("x", "x", "continuous", 5, 60.0, 0.31), Rule("o", "o", "ordinal", 4, 3.0, 0.29), Rule("f", "f", "binary", 3, True, 0.28), Rule("c", "c", "categorical", 2, "b", 0.33)]
MET = [lambda r: r[1] >= 60, lambda r: r[2] >= 3, lambda r: r[3], lambda r: r[4] == "b"]


def test_predicates(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 1.0), (2, None), (3, 3.0)], "code int, v double")
    on = lambda rule: [r[0] for r in df.orderBy("code").select(rules.predicate(rule)).collect()]
    assert on(Rule("r", "code", "binary")) == [False, True, False, False]
    assert on(Rule("r", "v", "continuous", threshold=1.0)) == [False, True, False, True]  # neither NaN nor null is large
    flags = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r[0] for r in flags.select(rules.predicate(Rule("r", "f", "ordinal", threshold=False))).collect()] == [False, True, False]


def test_scan_equals_brute_force(data):
    rows, df = data
    got = {(r["feature"], r["threshold"]): (r["tp"], r["fp"]) for r in rules.threshold_scan(df, ["x", "o"], "y").collect()}
    want = {(n, float(t)): (sum(r[k] >= t and r[5] == 1 for r in rows), sum(r[k] >= t and r[5] == 0 for r in rows)) for n, k in (("x", 1), ("o", 2)) for t in {r[k] for r in rows}}
    assert got == want


def places(n, most=100):
    return list(range(n)) if n <= most else [int(k * ((n - 1) / (most - 1.0))) for k in range(most - 1)] + [n - 1]


@pytest.mark.parametrize("n", [5, 100, 109, 250, 271])
def test_thinning(spark, n):
    df = spark.range(n).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("y"))
    got = rules.candidates(df, {"x": "continuous"}, "y").orderBy("pos").collect()
    assert [int(r["threshold"]) for r in got] == sorted(set(places(n))) and [r["pos"] for r in got] == list(range(len(got)))
    if n == 250:
        assert [int(r["threshold"]) for r in got[:8]] == [0, 2, 5, 7, 10, 12, 15, 17]


def test_ordinal_candidates_leave_zero_out(data, spark):
    _, df = data
    got = [r["threshold"] for r in rules.candidates(df, {"o": "ordinal"}, "y").orderBy("pos").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, 5.0]
    zeros = spark.createDataFrame([(0, 1), (0, 0)], "o int, y int")
    assert [r["threshold"] for r in rules.candidates(zeros, {"o": "ordinal"}, "y").collect()] == [0.0]


def test_best_threshold_ties(spark):
    scan = spark.createDataFrame([("f", 0, 1.0, 4, 4, 0.5), ("f", 1, 2.0, 2, 2, 0.5), ("f", 2, 3.0, 1, 1, 0.5), ("g", 0, 1.0, 0, 1, 0.9)], "feature string, pos int, threshold double, tp long, fp long, precision double")
    best = lambda ties: [r["threshold"] for r in rules.best_thresholds(scan, 1, ties).collect()]
    assert best("highest_support") == [1.0] and best("lowest_threshold") == [1.0] and best("highest_threshold") == [3.0]
    assert rules.filtered(rules.best_thresholds(scan), 0.4).count() == 1 and rules.filtered(rules.best_thresholds(scan), 0.99).count() == 1


def test_calibrate(data):
    rows, df = data
    done = rules.calibrate(df, RULES, "y")
    assert [r.rule_id for r in done] == ["x", "o", "f", "c"]
    for r, k in zip(done, (1, 2, 3, 4)):
        fired = [row for row in rows if (row[k] >= r.threshold if r.kind in ("continuous", "ordinal") else row[k] == r.threshold)]
        assert r.support == sum(row[5] for row in fired) and abs(r.precision - r.support / len(fired)) < 1e-12
    assert [r.rule_id for r in rules.sorted_rules(RULES, "precision_desc")] == ["c", "x", "o", "f"]
    assert [r.rule_id for r in rules.sorted_rules(RULES, "combined")] == ["x", "o", "f", "c"]


def test_or_cumulative_equals_brute_force(data):
    rows, df = data
    for r in combining.or_cumulative(df, RULES, "y").collect():
        fired = [any(m(row) for m in MET[: r["pos"] + 1]) for row in rows]
        assert (r["tp"], r["fp"], r["fn"]) == tuple(sum(a == f and row[5] == y for f, row in zip(fired, rows)) for a, y in ((True, 1), (True, 0), (False, 1)))


def test_sweep_equals_brute_force(data):
    rows, df = data
    swept = combining.weighted_scoring(df, RULES, "y", min_precision=0.0)
    best = combining.best_cutoff(swept).first()
    found = None
    for k in (3, 4):
        score = [sum((r.precision if m(row) else 0.0) for r, m in zip(RULES[:k], MET)) for row in rows]
        distinct = sorted({s for s in score if s > 0})
        cuts = sorted({c for i, s in enumerate(distinct) for c in ([s] if i + 1 == len(distinct) else [s, (s + distinct[i + 1]) / 2, s * 1.1])} | set(combining.V.ABSOLUTE_CUTOFFS))
        for c in cuts:
            tp, fp = (sum(s >= c and row[5] == y for s, row in zip(score, rows)) for y in (1, 0))
            fn = sum(row[5] for row in rows) - tp
            if tp and (found is None or 2 * tp / (2 * tp + fp + fn) > found[0] + 1e-12):
                found = (2 * tp / (2 * tp + fp + fn), k, c)
    assert abs(best["f1"] - found[0]) < 1e-12 and best["k"] == found[1] and abs(best["cutoff"] - found[2]) < 1e-9


def test_greedy_tiers_and_votes(data):
    rows, df = data
    total, fired, want = sum(r[5] for r in rows), [False] * len(rows), []
    for rule, m in zip(RULES, MET):
        new = [a or m(r) for a, r in zip(fired, rows)]
        tp = lambda f: sum(a and r[5] == 1 for a, r in zip(f, rows))
        if tp(new) > tp(fired):
            fired = new
            want.append((len(want), rule.rule_id, tp(new), sum(a and r[5] == 0 for a, r in zip(new, rows))))
        if tp(fired) / total >= 0.5:
            break
    assert combining.greedy_cover(df, RULES, "y") == want
    assert [r for _, r, _, _ in combining.hierarchical(df, RULES, "y", tiers=[(0.3, 2)], min_precision=0.0)] == ["x", "c"]
    votes = {r["strategy"]: r for r in combining.ensemble(df, RULES, "y", top=2).collect()}
    assert votes["unanimous"]["predicted"] <= votes["majority"]["predicted"] and votes["majority"]["predicted"] == votes["weighted"]["predicted"]


def test_evaluation_and_report(data, spark):
    rows, df = data
    m = evaluation.evaluate(df, RULES, 0.6, "y").first()
    fired = [sum((r.precision if k(row) else 0.0) for r, k in zip(RULES, MET)) >= 0.6 for row in rows]
    assert m["tp"] == sum(f and r[5] == 1 for f, r in zip(fired, rows)) and m["tp"] + m["fp"] + m["fn"] + m["tn"] == 400
    some = evaluation.examples(df, RULES, "id", "y")
    assert {r["n"] for r in some.groupBy("rule_id").agg(F.count("*").alias("n")).collect()} == {2}
    texts = df.select("id", F.concat(F.lit("a|b\n"), F.repeat(F.lit("x"), 300)).alias("t"))
    quoted = evaluation.with_excerpts(some, texts, "id", "t")
    excerpt = quoted.first()["excerpt"]
    assert excerpt.startswith("a&#124;b ") and excerpt.endswith("...") and "\n" not in excerpt
    lines = [r["line"] for r in evaluation.report(evaluation.evaluate(df, RULES, 0.6, "y"), RULES, quoted).orderBy("line_no").collect()]
    assert len(lines) == 7 + len(RULES) and lines[7].startswith("| 1 | x | continuous | 60.000 | 0.310 |")


def test_over_sixty_rules(data):
    """Sets of rules take as many longs as they need; scores look at the prefixes only."""
    rows, df = data
    many = [Rule(f"x{i}", "x", "continuous", 100 - i, float(100 - i), 0.3 + i / 1000) for i in range(100)]
    met = lambda i, row: row[1] >= 100 - i
    sets = combining.fired_sets(df, many, "y").select([combining.holds(i).alias(f"h{i}") for i in (0, 61, 62, 99)] + ["n"]).collect()
    for i in (0, 61, 62, 99):
        assert sum(r["n"] for r in sets if r[f"h{i}"]) == sum(met(i, row) for row in rows)
    assert combining.weighted_scoring(df, many, "y", min_precision=0.0).select(F.max("k")).first()[0] == 20
    cover = combining.greedy_cover(df, many, "y", target_recall=2.0)
    assert cover[-1][2] == sum(row[5] for row in rows if any(met(i, row) for i in range(100)))
    assert combining.combine(df, many, "y", "simple_or").count() == 100
    assert combining.combine(df, many, "y", "hierarchical").count() >= 1


def counted(rows, fired):
    tp, fp = (sum(bool(f) and row[5] == y for f, row in zip(fired, rows)) for y in (1, 0))
    return tp, fp, sum(row[5] for row in rows) - tp


def plain_f1(tp, fp, fn):
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


@pytest.mark.parametrize("voting", ["majority", "unanimous", "weighted"])
def test_ensemble_equals_brute_force(data, voting):
    """Votes of three sub-models that look at fifteen rules, with a floor of the balanced one's precision."""
    rows, df = data
    rng = random.Random(9)
    many = [Rule(f"r{i}", "x", "continuous", 50 - i, round(rng.random() * 100, 2), rng.random()) for i in range(22)]
    met = [[row[1] >= r.threshold for row in rows] for r in many]
    either = lambda chosen: [any(met[i][j] for i in chosen) for j in range(len(rows))]
    precise = sorted(range(22), key=lambda i: -many[i].precision)[:5]
    chosen, covered = [], set()
    for i in range(15):
        new = {j for j, row in enumerate(rows) if met[i][j] and row[5] == 1} - covered
        if new:
            chosen.append(i)
            covered |= new
            if len(covered) / sum(row[5] for row in rows) >= 0.5:
                break
    best, balanced = 0.0, []
    for k in range(1, 16):
        tp, fp, fn = counted(rows, either(range(k)))
        if tp + fp and tp / (tp + fp) >= 0.2 and plain_f1(tp, fp, fn) > best:
            best, balanced = plain_f1(tp, fp, fn), list(range(k))
    votes = [sum(v) for v in zip(either(precise), either(chosen), either(balanced))]
    decided = [v == 3 if voting == "unanimous" else v >= 2 for v in votes]
    left, total, used = list(decided), sum(decided), []
    for i in range(22):
        if any(a and b for a, b in zip(left, met[i])):
            used.append(f"r{i}")
            left = [a and not b for a, b in zip(left, met[i])]
            if sum(left) < 0.1 * total:
                break
    got = combining.combine(df, many, "y", "ensemble", voting=voting).orderBy("rule_index").collect()
    assert [r["rule_id"] for r in got] == used
    tp, fp, fn = counted(rows, decided)
    assert {(r["combined_support"], r["combined_false_positives"]) for r in got} == {(tp, float(fp))}
    assert abs(got[0]["combined_f1"] - plain_f1(tp, fp, fn)) < 1e-12 and got[0]["scoring_threshold"] is None


def test_strategies(data):
    rows, df = data
    simple = combining.combine(df, RULES, "y", "simple_or").orderBy("rule_index").collect()
    for i, r in enumerate(simple):
        assert (r["combined_support"], int(r["combined_false_positives"])) == counted(rows, [any(m(row) for m in MET[: i + 1]) for row in rows])[:2]
    assert combining.combine(df, RULES, "y", "simple_or", most=2).count() == 2
    assert combining.combine(df, RULES, "y", "simple_or", stop_at=0.0).count() == 1
    # rules that are not precise enough go, unless all would; those without a threshold always
    loose = [Rule("none", "x", "continuous"), *RULES]
    assert [r["rule_id"] for r in combining.combine(df, loose, "y", "simple_or", least_precision=0.3).orderBy("rule_index").collect()] == ["x", "c"]
    assert combining.combine(df, loose, "y", "simple_or", least_precision=0.9).count() == 4
    scored = combining.combine(df, RULES, "y")
    assert scored.columns == combining.combine(df, RULES, "y", "hierarchical").columns and scored.first()["scoring_threshold"] > 0
    with pytest.raises(ValueError):
        combining.combine(df, RULES, "y", "guessing")
