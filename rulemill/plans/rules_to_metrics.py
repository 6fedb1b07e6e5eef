"""Queries: rule predicates, threshold scans, combination and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import fixed
from ..operators import combining, evaluation, rules, splitting
from ..spec import Rule
from .registry import query
from .virtual import DOC_RULES, ITEM_RULES, load

_MET = {"r1": "price >= 60000", "r2": "quantity >= 40", "r3": "closed", "r4": "discount >= 0.08", "r5": "state = 'O'"}
_DOC_MET = {"d1": "n_chars >= 2500", "d2": "is_long", "d3": "lang = 'en'"}
_P = "CASE WHEN {tp} + {fp} = 0 THEN 0.0 ELSE CAST({tp} AS DOUBLE) / ({tp} + {fp}) END"
_R = "CASE WHEN {tp} + {fn} = 0 THEN 0.0 ELSE CAST({tp} AS DOUBLE) / ({tp} + {fn}) END"


def _metrics(source: str, keep: str) -> str:
    """Precision, recall and F1 from tp, fp and fn of a table, with other columns."""
    p, r = _P.format(tp="tp", fp="fp"), _R.format(tp="tp", fn="fn")
    return f"""SELECT {keep}, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
        FROM (SELECT *, {p} AS precision, {r} AS recall FROM {source})"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns])


def _each(table: str, met: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER (WHERE ({m}) AND label = 1) AS tp, count(*) FILTER (WHERE ({m}) AND label = 0) AS fp FROM {table}" for k, m in met.items())


@query(f", e AS ({_each('items', _MET)}) SELECT rule_id, tp, fp, round({_P.format(tp='tp', fp='fp')}, 9) AS precision FROM e", ("items",))
def rule_eval_single(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rules.evaluate_each(load(spark, d, "items"), ITEM_RULES, "label").drop("fired"), "precision")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER (WHERE {m}) AS fired FROM docs" for k, m in _DOC_MET.items()) + ")", ("docs",))
def rule_fire_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.evaluate_each(load(spark, d, "docs"), DOC_RULES, "label").select("rule_id", "fired")


_KINDS = {"price": "continuous", "quantity": "ordinal", "discount": "continuous", "level": "ordinal"}


def _scan(table: str, features: tuple[str, ...]) -> str:
    """CTE scan: suffix sums of every distinct value of each feature."""
    one = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS threshold, sum(label) AS p, count(*) - sum(label) AS n FROM {table} GROUP BY 2" for c in features)
    return f""", counts AS ({one}), scan AS (SELECT feature, threshold,
        CAST(sum(p) OVER (PARTITION BY feature ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (PARTITION BY feature ORDER BY threshold DESC) AS BIGINT) AS fp FROM counts)"""


@query(f"{_scan('docs', ('n_chars',))} SELECT feature, threshold, tp, fp, round({_P.format(tp='tp', fp='fp')}, 9) AS precision FROM scan", ("docs",))
def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rules.threshold_scan(load(spark, d, "docs"), ["n_chars"], "label"), "precision")


_CANDIDATES = f"""{_scan('items', tuple(_KINDS))}, ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n
        FROM scan WHERE feature IN ('price', 'discount') OR (threshold IN (1, 2, 3, 4, 5))),
    cand AS (SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS INT) AS pos, threshold, tp, fp, {_P.format(tp='tp', fp='fp')} AS precision FROM ranked
        WHERE feature NOT IN ('price', 'discount') OR n <= 100 OR i = n - 1 OR i IN (SELECT CAST(trunc(k * ((r.n - 1) / 99.0::DOUBLE)) AS BIGINT) FROM range(0, 99) t(k), (SELECT DISTINCT feature AS f, n FROM ranked) r WHERE r.f = ranked.feature))"""


@query(f"{_CANDIDATES} SELECT feature, pos, threshold FROM cand", ("items",))
def candidate_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rules.candidates(load(spark, d, "items"), _KINDS, "label").select("feature", "pos", "threshold")


@query(
    """, p AS (SELECT 'price' AS feature, unnest(quantile_cont(price, [0.10, 0.25, 0.50, 0.75, 0.90, 0.95])) AS t FROM items
    UNION SELECT 'quantity', unnest(quantile_cont(quantity, [0.10, 0.25, 0.50, 0.75, 0.90, 0.95])) FROM items)
    SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY t) - 1 AS INT) AS pos, round(t, 6) AS threshold FROM p""",
    ("items",),
)
def candidate_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rules.percentile_candidates(load(spark, d, "items"), ["price", "quantity"]).withColumn("threshold", F.round("threshold", 6))


_BEST = f"{_CANDIDATES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY precision DESC, tp DESC, pos) AS r FROM cand WHERE tp >= 1) WHERE r = 1)"


def _best(spark: SparkSession, d: str) -> DataFrame:
    return rules.best_thresholds(rules.candidates(load(spark, d, "items"), _KINDS, "label"))


@query(f"{_BEST} SELECT feature AS rule_id, threshold, round(precision, 9) AS precision, tp AS support FROM best", ("items",))
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select(F.col("feature").alias("rule_id"), "threshold", F.round("precision", 9).alias("precision"), F.col("tp").alias("support"))


@query(f"{_BEST} SELECT feature AS rule_id, round(precision, 9) AS precision FROM best WHERE precision >= 0.345 OR NOT EXISTS (SELECT 1 FROM best WHERE precision >= 0.345)", ("items",))
def rule_candidates_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rules.filtered(_best(spark, d), 0.345).select(F.col("feature").alias("rule_id"), F.round("precision", 9).alias("precision"))


def _own_precision() -> str:
    return f", e AS ({_each('items', _MET)}), own AS (SELECT rule_id, tp, fp, {_P.format(tp='tp', fp='fp')} AS precision, CASE rule_id WHEN 'r1' THEN 90 WHEN 'r2' THEN 70 WHEN 'r3' THEN 50 WHEN 'r4' THEN 30 ELSE 10 END AS weight FROM e)"


def _measured(spark: SparkSession, d: str) -> list[Rule]:
    """ITEM_RULES with their precision on the items: a row a rule."""
    found = {r["rule_id"]: r for r in rules.evaluate_each(load(spark, d, "items"), ITEM_RULES, "label").collect()}
    return [Rule(r.rule_id, r.feature, r.kind, r.weight, r.threshold, found[r.rule_id]["precision"], found[r.rule_id]["tp"]) for r in ITEM_RULES]


@query(f"{_own_precision()} SELECT CAST(row_number() OVER (ORDER BY 0.7 * (weight / 90) + 0.3 * precision DESC, rule_id) - 1 AS INT) AS pos, rule_id FROM own", ("items",))
def rule_sort_combined(spark: SparkSession, d: str) -> DataFrame:
    ordered = rules.sorted_rules(_measured(spark, d), "combined")
    return spark.createDataFrame([(i, r.rule_id) for i, r in enumerate(ordered)], "pos int, rule_id string")


_SCORE = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {_MET[r.rule_id]} THEN {r.precision}::DOUBLE ELSE 0.0::DOUBLE END" for r in ITEM_RULES)])
_HIST = f", scored AS (SELECT {_SCORE} AS score, label FROM items), hist AS (SELECT score, CAST(sum(label) AS BIGINT) AS positives, count(*) AS n FROM scored GROUP BY score)"


@query(f"{_HIST} SELECT round(score, 9) AS score, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM scored GROUP BY 1", ("items",))
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    scored = load(spark, d, "items").select(F.round(combining.score(ITEM_RULES), 9).alias("score"), "label")
    return scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query(f"{_HIST} SELECT round(score, 9) AS score, positives, n FROM hist", ("items",))
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(combining.score_histogram(load(spark, d, "items"), ITEM_RULES, "label"), "score")


def _sweep(k: int) -> str:
    terms = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {_MET[r.rule_id]} THEN {r.precision}::DOUBLE ELSE 0.0::DOUBLE END" for r in ITEM_RULES[:k])])
    fixed = ", ".join(f"({c}::DOUBLE)" for c in V.ABSOLUTE_CUTOFFS)
    return f""", h{k} AS (SELECT {terms} AS score, sum(label) AS p, count(*) - sum(label) AS n FROM items GROUP BY 1),
    x{k} AS (SELECT score, lead(score) OVER (ORDER BY score) AS nx FROM h{k} WHERE score > 0),
    c{k} AS (SELECT score AS cutoff FROM x{k} UNION SELECT (score + nx) / 2 FROM x{k} WHERE nx IS NOT NULL UNION SELECT score * 1.1::DOUBLE FROM x{k} WHERE nx IS NOT NULL UNION SELECT * FROM (VALUES {fixed})),
    s{k} AS (SELECT {k} AS k, cutoff, CAST(sum(p) AS BIGINT) AS tp, CAST(sum(n) AS BIGINT) AS fp, CAST((SELECT sum(p) FROM h{k}) - sum(p) AS BIGINT) AS fn FROM c{k} JOIN h{k} ON score >= cutoff WHERE cutoff > 0 GROUP BY cutoff)"""


_SWEEPS = f"""{_sweep(3)}{_sweep(5)}, sweeps AS ({_metrics('(SELECT * FROM s3 UNION ALL SELECT * FROM s5)', 'CAST(k AS INT) AS k, cutoff, tp, fp')}), good AS (SELECT * FROM sweeps WHERE tp > 0 AND precision >= 0.2)"""


def _swept(spark: SparkSession, d: str) -> DataFrame:
    return combining.weighted_scoring(load(spark, d, "items"), ITEM_RULES, "label", prefixes=(3, 5))


@query(f"{_SWEEPS} SELECT k, round(cutoff, 9) AS cutoff, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, tp AS support FROM good", ("items",))
def score_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_swept(spark, d).withColumnRenamed("tp", "support"), "cutoff", "precision", "recall", "f1").select("k", "cutoff", "precision", "recall", "f1", "support")


_RULE_ROWS = ", ".join(f"({i}, '{r.rule_id}', '{r.feature}', '{r.kind}', {r.weight}, {r.threshold if isinstance(r.threshold, float) else 'NULL'}::DOUBLE, {'NULL' if isinstance(r.threshold, float) else repr(str(r.threshold).lower() if isinstance(r.threshold, bool) else r.threshold)}, {r.precision}::DOUBLE, {r.support})" for i, r in enumerate(ITEM_RULES))
_CALIBRATED = f"""{_SWEEPS}, top AS (SELECT * FROM good ORDER BY f1 DESC, k, cutoff LIMIT 1), cal AS (SELECT v.*, top.* FROM (VALUES {_RULE_ROWS}) v(rule_index, rule_id, feature, feature_type, weight, threshold_num, threshold_str, rule_precision, rule_support) JOIN top ON rule_index < k)"""


@query(
    f"""{_CALIBRATED} SELECT CAST(rule_index AS BIGINT) AS rule_index, rule_id, feature, feature_type, 'success' AS outcome, CAST(weight AS BIGINT) AS weight, threshold_num, threshold_str, rule_precision, CAST(rule_support AS BIGINT) AS rule_support,
    round(cutoff, 9) AS scoring_threshold, round(precision, 9) AS combined_precision, tp AS combined_support, round(recall, 9) AS combined_recall, round(f1, 9) AS combined_f1, round(tp / precision - tp, 3) AS combined_false_positives FROM cal""",
    ("items",),
)
def calibrated_rules(spark: SparkSession, d: str) -> DataFrame:
    found = combining.calibrated_rules(_swept(spark, d), ITEM_RULES)
    return _rounded(found, "scoring_threshold", "combined_precision", "combined_recall", "combined_f1").withColumn("combined_false_positives", F.round("combined_false_positives", 3))


@query(
    f"""{_CALIBRATED} SELECT feature, outcome, feature_type, threshold, rule_precision, rule_support, combined_precision, combined_support, combined_recall FROM
    (SELECT feature, 'success' AS outcome, feature_type, coalesce(printf('%.3f', threshold_num), threshold_str) AS threshold, printf('%.3f', rule_precision) AS rule_precision, CAST(rule_support AS BIGINT) AS rule_support,
    printf('%.3f', precision) AS combined_precision, tp AS combined_support, printf('%.3f', recall) AS combined_recall FROM cal)""",
    ("items",),
)
def threshold_metrics_table(spark: SparkSession, d: str) -> DataFrame:
    three = lambda c: fixed(F.col(c), 3)
    found = combining.calibrated_rules(_swept(spark, d), ITEM_RULES)
    threshold = F.when(F.col("threshold_num").isNotNull(), three("threshold_num")).otherwise(F.col("threshold_str"))
    return found.select("feature", "outcome", "feature_type", threshold.alias("threshold"), three("rule_precision").alias("rule_precision"), "rule_support", three("combined_precision").alias("combined_precision"), "combined_support", three("combined_recall").alias("combined_recall"))


def _or_rows() -> str:
    seen, out = [], []
    for i, r in enumerate(ITEM_RULES):
        seen.append(f"({_MET[r.rule_id]})")
        met = " OR ".join(seen)
        out.append(f"SELECT {i} AS pos, '{r.rule_id}' AS rule_id, count(*) FILTER (WHERE ({met}) AND label = 1) AS tp, count(*) FILTER (WHERE ({met}) AND label = 0) AS fp, count(*) FILTER (WHERE NOT ({met}) AND label = 1) AS fn FROM items")
    return " UNION ALL ".join(out)


@query(f", o AS ({_or_rows()}), m AS ({_metrics('o', 'pos, rule_id, tp, fp, fn')}) SELECT pos, rule_id, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM m", ("items",))
def or_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(combining.or_cumulative(load(spark, d, "items"), ITEM_RULES, "label"), "precision", "recall", "f1")


_BITS = " + ".join(f"CASE WHEN {_MET[r.rule_id]} THEN {1 << i} ELSE 0 END" for i, r in enumerate(ITEM_RULES))
_MASKS = f""", sets AS (SELECT {_BITS} AS fired, sum(label) AS p, count(*) - sum(label) AS n FROM items GROUP BY 1),
    masks AS (SELECT CAST(m AS BIGINT) AS mask, CAST(coalesce(sum(p), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n), 0) AS BIGINT) AS fp FROM range(0, 32) t(m) LEFT JOIN sets ON (fired & m) <> 0 GROUP BY 1),
    pos_all AS (SELECT sum(p) AS total FROM sets)"""
#: Rules that the greedy and tiered queries choose from: the same rules in an order that makes both decide.
_ORDERED = [ITEM_RULES[i] for i in (3, 0, 1, 2, 4)]
_NAMES = "(VALUES " + ", ".join(f"({ITEM_RULES.index(r)}, {i}, '{r.rule_id}')" for i, r in enumerate(_ORDERED)) + ") names(bit, step, rule_id)"


@query(
    f"""/*recursive*/{_MASKS}, g AS (SELECT 0 AS step, CAST(0 AS BIGINT) AS mask, false AS took, CAST('' AS VARCHAR) AS rule_id UNION ALL
    SELECT g.step + 1, CASE WHEN new.tp > old.tp THEN new.mask ELSE g.mask END, new.tp > old.tp, names.rule_id FROM g JOIN {_NAMES} ON names.step = g.step
    JOIN masks old ON old.mask = g.mask JOIN masks new ON new.mask = (g.mask | (1::BIGINT << names.bit)), pos_all WHERE old.tp / total < 0.5)
    SELECT CAST(row_number() OVER (ORDER BY step) - 1 AS INT) AS pos, rule_id, tp, fp FROM g JOIN masks USING (mask) WHERE took""",
    ("items",),
)
def greedy_cover(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(combining.greedy_cover(load(spark, d, "items"), _ORDERED, "label"), "pos int, rule_id string, tp long, fp long")


def _tiers(order: list[Rule]) -> str:
    """Recursive CTE g: the tiers' steps over rules in an order; took marks a rule that is admitted."""
    steps = [(t, r) for t, (least, most) in enumerate(V.TIERS) for r in [r for r in order if r.precision >= least][:most]]
    rows = ", ".join(f"({s}, {ITEM_RULES.index(r)}, '{r.rule_id}', {str(s + 1 == len(steps) or steps[s + 1][0] != t).lower()})" for s, (t, r) in enumerate(steps))
    return f"""g AS (SELECT 0 AS step, CAST(0 AS BIGINT) AS mask, false AS took, CAST('' AS VARCHAR) AS rule_id, false AS over UNION ALL
    SELECT g.step + 1, chosen.mask, chosen.mask = new.mask AND new.tp + new.fp > 0 AND new.tp / (new.tp + new.fp) >= 0.2, v.rule_id, v.last AND chosen.tp / total >= 0.5
    FROM g JOIN (VALUES {rows}) v(step, bit, rule_id, last) ON v.step = g.step JOIN masks new ON new.mask = (g.mask | (1::BIGINT << v.bit))
    JOIN masks chosen ON chosen.mask = CASE WHEN new.tp + new.fp > 0 AND new.tp / (new.tp + new.fp) >= 0.2 THEN new.mask ELSE g.mask END, pos_all WHERE NOT g.over)"""


@query(f"/*recursive*/{_MASKS}, {_tiers(_ORDERED)} SELECT CAST(row_number() OVER (ORDER BY step) - 1 AS INT) AS pos, rule_id, tp, fp FROM g JOIN masks USING (mask) WHERE took", ("items",))
def hierarchical_combine(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(combining.hierarchical(load(spark, d, "items"), _ORDERED, "label"), "pos int, rule_id string, tp long, fp long")


def _votes(top: int) -> str:
    """CTEs: greedy steps c over the rules in their own order, the sub-models' masks, and every set of firing rules with its votes."""
    precise = sum(1 << i for i in sorted(range(len(ITEM_RULES)), key=lambda i: -ITEM_RULES[i].precision)[:top])
    names = "(VALUES " + ", ".join(f"({i}, {i})" for i in range(len(ITEM_RULES))) + ") names(bit, step)"
    prefixes = ", ".join(f"({i}, {(2 << i) - 1})" for i in range(len(ITEM_RULES)))
    return f"""c AS (SELECT 0 AS step, CAST(0 AS BIGINT) AS mask UNION ALL
    SELECT c.step + 1, CASE WHEN new.tp > old.tp THEN new.mask ELSE c.mask END FROM c JOIN {names} ON names.step = c.step
    JOIN masks old ON old.mask = c.mask JOIN masks new ON new.mask = (c.mask | (1::BIGINT << names.bit)), pos_all WHERE old.tp / total < 0.5),
    prefix AS (SELECT pos, m.mask, tp, fp, total - tp AS fn FROM (VALUES {prefixes}) v(pos, mask) JOIN masks m USING (mask), pos_all),
    balanced AS ({_metrics('prefix', 'pos, mask')}),
    sub AS (SELECT {precise}::BIGINT AS hp, (SELECT mask FROM c ORDER BY step DESC LIMIT 1) AS hr, coalesce((SELECT mask FROM balanced WHERE precision >= 0.2 AND f1 > 0 ORDER BY f1 DESC, pos LIMIT 1), 0) AS ba),
    hits AS (SELECT fired, p, n, (fired & hp) <> 0 AS a, (fired & hr) <> 0 AS b, (fired & ba) <> 0 AS c FROM sets, sub),
    voted AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS votes FROM hits)"""


_VOTES = {"high_precision": "a", "high_recall": "b", "balanced": "c", "majority": "votes >= 2", "unanimous": "votes = 3", "weighted": "votes / 3.0 >= 0.5"}


@query(f"/*recursive*/{_MASKS}, {_votes(2)} " + " UNION ALL ".join(f"SELECT '{k}' AS strategy, CAST(coalesce(sum(p + n) FILTER (WHERE {e}), 0) AS BIGINT) AS predicted, CAST(coalesce(sum(p) FILTER (WHERE {e}), 0) AS BIGINT) AS tp FROM voted" for k, e in _VOTES.items()), ("items",))
def ensemble_vote(spark: SparkSession, d: str) -> DataFrame:
    return combining.ensemble(load(spark, d, "items"), ITEM_RULES, "label", top=2)


_SHOWN = ("combined_precision", "combined_recall", "combined_f1")
_PLACES = ", ".join(f"({i}, '{r.rule_id}')" for i, r in enumerate(ITEM_RULES))


@query(
    f"""/*recursive*/{_CALIBRATED}{_MASKS}, {_tiers(ITEM_RULES)}, {_votes(5)}, o AS ({_or_rows()}), places AS (SELECT * FROM (VALUES {_PLACES}) v(place, rule_id)),
    kept AS (SELECT CASE {' '.join(f'WHEN (fired & {1 << i}) <> 0 THEN {i}' for i in range(len(ITEM_RULES)))} END AS place, sum(p + n) AS n FROM voted WHERE votes >= 2 GROUP BY 1),
    fresh AS (SELECT place, n, sum(n) OVER () AS total, sum(n) OVER () - sum(n) OVER (ORDER BY place) + n AS remaining FROM kept WHERE place IS NOT NULL),
    simple AS (SELECT 'simple_or' AS strategy, CAST(pos AS BIGINT) AS rule_index, rule_id, tp, fp, fn FROM o),
    tiers AS (SELECT 'hierarchical', row_number() OVER (ORDER BY step) - 1, rule_id, m.tp, m.fp, CAST(total - m.tp AS BIGINT) FROM g, pos_all, (SELECT tp, fp FROM masks WHERE mask = (SELECT mask FROM g ORDER BY step DESC LIMIT 1)) m WHERE took),
    vote AS (SELECT 'ensemble', row_number() OVER (ORDER BY place) - 1, rule_id, v.tp, v.fp, CAST(total_p - v.tp AS BIGINT) FROM fresh JOIN places USING (place),
        (SELECT CAST(sum(p) FILTER (WHERE votes >= 2) AS BIGINT) AS tp, CAST(sum(n) FILTER (WHERE votes >= 2) AS BIGINT) AS fp, sum(p) AS total_p FROM voted) v WHERE remaining >= 0.1 * total),
    other AS (SELECT * FROM simple UNION ALL SELECT * FROM tiers UNION ALL SELECT * FROM vote),
    measured AS ({_metrics('other', 'strategy, rule_index, rule_id, tp, fp')})
    SELECT strategy, rule_index, rule_id, tp AS combined_support, CAST(fp AS DOUBLE) AS combined_false_positives, round(precision, 9) AS combined_precision, round(recall, 9) AS combined_recall, round(f1, 9) AS combined_f1 FROM measured
    UNION ALL SELECT 'weighted_scoring', CAST(rule_index AS BIGINT), rule_id, tp, round(tp / precision - tp, 3), round(precision, 9), round(recall, 9), round(f1, 9) FROM cal""",
    ("items",),
)
def combine_strategies(spark: SparkSession, d: str) -> DataFrame:
    """The rules that each strategy combines, with the figures of its combination."""
    items, out = load(spark, d, "items"), None
    for strategy in combining.STRATEGIES:
        one = combining.combine(items, ITEM_RULES, "label", strategy).select(F.lit(strategy).alias("strategy"), "rule_index", "rule_id", "combined_support", F.round("combined_false_positives", 3).alias("combined_false_positives"), *_SHOWN)
        out = one if out is None else out.unionByName(one)
    return _rounded(out, *_SHOWN)


def _confusion(met: str, where: str = "") -> str:
    return f"""c AS (SELECT count(*) FILTER (WHERE ({met}) AND label = 1) AS tp, count(*) FILTER (WHERE ({met}) AND label = 0) AS fp,
        count(*) FILTER (WHERE NOT ({met}) AND label = 1) AS fn, count(*) FILTER (WHERE NOT ({met}) AND label = 0) AS tn FROM items {where})"""


@query(f", {_confusion(_MET['r1'] + ' OR ' + _MET['r2'])}, m AS ({_metrics('c', 'tp, fp, fn, tn')}) SELECT tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM m", ("items",))
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    met = rules.predicate(ITEM_RULES[0]) | rules.predicate(ITEM_RULES[1])
    return _rounded(evaluation.confusion(load(spark, d, "items"), met, "label"), "precision", "recall", "f1")


@query(
    f""", t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || ':42'), row_id) <= CASE label WHEN 1 THEN 100 ELSE 900 END AS test FROM items),
    {_confusion(_SCORE + ' >= 0.65').replace('FROM items', 'FROM t WHERE test')}, m AS ({_metrics('c', 'tp, fp, fn, tn')})
    SELECT tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, 0.65::DOUBLE AS scoring_threshold, tp + fp AS total_predictions FROM m""",
    ("items",),
)
def evaluate_rules(spark: SparkSession, d: str) -> DataFrame:
    test = splitting.stratified_split(load(spark, d, "items"), "row_id", "label", {1: 100, 0: 900}).where("split = 'test'")
    return _rounded(evaluation.evaluate(test, ITEM_RULES, 0.65, "label"), "precision", "recall", "f1")


_EXAMPLES = ", ex AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, doc_id, text FROM docs WHERE label = 1 AND ({m})" for k, m in _DOC_MET.items()) + """),
    few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r FROM ex) WHERE r <= 2),
    cut AS (SELECT rule_id, CAST(r AS INT) AS "rank", doc_id, replace(replace(CASE WHEN length(text) > 197 THEN left(text, 197) || '...' ELSE text END, chr(10), ' '), '|', '&#124;') AS excerpt FROM few)"""


@query(f"{_EXAMPLES} SELECT rule_id, \"rank\", doc_id AS row_id, excerpt FROM cut", ("docs",))
def rule_examples(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "docs")
    found = evaluation.with_excerpts(evaluation.examples(docs, DOC_RULES, "doc_id", "label"), docs, "doc_id", "text")
    return found.select("rule_id", "rank", F.col("doc_id").alias("row_id"), "excerpt")


_DOC_ROWS = ", ".join(f"({i + 1}, '{r.rule_id}', '| {i + 1} | {r.feature} | {r.kind} | {f'{r.threshold:.3f}' if isinstance(r.threshold, float) else r.threshold} | {r.precision:.3f} | {r.support} | ')" for i, r in enumerate(DOC_RULES))
_DOC_SCORE = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {_DOC_MET[r.rule_id]} THEN {r.precision}::DOUBLE ELSE 0.0::DOUBLE END" for r in DOC_RULES)])


@query(
    f"""{_EXAMPLES}, {_confusion(_DOC_SCORE + ' >= 0.85').replace('FROM items', 'FROM docs')}, m AS ({_metrics('c', 'tp, fp, fn, tn')}),
    q AS (SELECT rule_id, string_agg('"' || excerpt || '"', '<br>' ORDER BY "rank", excerpt) AS quotes FROM cut GROUP BY rule_id),
    v AS (SELECT * FROM (VALUES {_DOC_ROWS}) v(n, rule_id, start))
    SELECT 0 AS line_no, '# Rule evaluation' AS line FROM m UNION ALL SELECT 1, printf('- precision: %.3f', precision) FROM m UNION ALL SELECT 2, printf('- recall: %.3f', recall) FROM m UNION ALL SELECT 3, printf('- F1: %.3f', f1) FROM m
    UNION ALL SELECT 4, printf('- true positives: %d, false positives: %d, predictions: %d', tp, fp, tp + fp) FROM m
    UNION ALL SELECT 5, '| # | Feature | Type | Threshold | Precision | Support | Examples |' UNION ALL SELECT 6, '|---|---|---|---|---|---|---|'
    UNION ALL SELECT CAST(n + 6 AS INT), start || coalesce(quotes, '') || ' |' FROM v LEFT JOIN q USING (rule_id)""",
    ("docs",),
)
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "docs")
    quoted = evaluation.with_excerpts(evaluation.examples(docs, DOC_RULES, "doc_id", "label"), docs, "doc_id", "text")
    return evaluation.report(evaluation.evaluate(docs, DOC_RULES, 0.85, "label"), DOC_RULES, quoted)

