"""The whole way from a raw text table to an evaluation report, as stages of a RulePipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import cleaning, combining, encoding, evaluation, explaining, graph, ordering, rules, selection, splitting, triples
from ..sources import records
from ..sources.tables import materialize
from ..spec import KINDS, FeatureSpec, Rule
from .pipeline import Figures, RulePipeline, Tables, Workspace


@dataclass(frozen=True)
class Plan:
    """What the stages need to know. specs name the raw columns; label is one of them, binary; key tells rows apart.

    describer, if given, tells about each row before the explainer does, and the explainer reads what it told.
    strategy, order, scoring and voting choose how rules are combined (see `combining.combine`); reply_bounds are the
    least and most characters of an explanation; target_rate weights positives when features are ranked.

    positive_rate, least_rows and train_rows bound what is accepted; imputation and casts are by kind (see
    `cleaning.fit`); numeric columns with up to most_levels values are ordinal; ties, tried, levels and most_thresholds
    choose thresholds (see `rules.calibrate`).
    """

    specs: Sequence[FeatureSpec]
    key: str
    label: str
    test_counts: Mapping[int, int]
    phrases: Mapping[str, str]
    keywords: Mapping[str, Sequence[str]] | None = None
    explainer: explaining.Explainer = explaining.template_explainer
    kinds: Mapping[str, str] = field(default_factory=dict)
    edges: Mapping[str, Sequence[float]] = field(default_factory=dict)
    features: int = 25
    rounds: int = 100
    batches: int = 17
    batch_rows: int = 30
    top_edges: int = 25
    seed: int = 42
    describer: explaining.Explainer | None = None
    reply_bounds: tuple[int, int | None] = (1, None)
    strategy: str = "weighted_scoring"
    order: str = "weight_desc"
    scoring: str = "precision_weighted"
    voting: str = "majority"
    least_precision: float = V.LEAST_RULE_PRECISION
    least_rows: int = 1
    target_rate: float | None = None
    positive_rate: tuple[float, float] = (0.0, 1.0)
    train_rows: tuple[float, float] = (1, float("inf"))
    imputation: Mapping[str, str] = field(default_factory=dict)
    casts: Mapping[str, str] = field(default_factory=dict)
    most_levels: int = 10
    ties: str = "highest_support"
    tried: str = "unique_values"
    levels: Sequence[int] = (1, 2, 3, 4, 5)
    most_thresholds: int = 100


def _no_nulls(df: DataFrame, columns: Sequence[str]) -> dict:
    """Checks that no column holds a null."""
    return {f"nulls_in_{c}": (F.count_if(F.col(c).isNull()), 0.0, 0.0) for c in columns}


#: The types that encoded columns of each kind have.
_TYPES = {"continuous": "double", "ordinal": "int", "binary": "boolean", "categorical": "int", "text": "string"}


def stages(raw: DataFrame, plan: Plan) -> dict:
    """Name -> stage. Each stage reads what it needs from the workspace, so a run can resume anywhere."""

    def clean(w: Workspace) -> Tables:
        lacks = [s.name for s in plan.specs if s.name not in raw.columns]
        if lacks:
            raise ValueError("the raw table lacks " + ", ".join(lacks))
        specs = [s if s.name != plan.key else FeatureSpec(plan.key, identifier=True) for s in plan.specs]
        rows, _ = cleaning.clean(raw.select(*[s.name for s in specs]), specs, plan.imputation, plan.casts)
        rows = rows.withColumn(plan.label, F.col(plan.label).cast("int"))
        y = F.col(plan.label)
        bounds = {"rows": (F.count("*"), float(plan.least_rows), float("inf")), "positive_rate": (F.avg(y), *plan.positive_rate), "labels_out_of_range": (F.count_if(~y.isin(0, 1)), 0.0, 0.0)}
        return Tables({"rows": rows}, {"rows": bounds | _no_nulls(rows, [s.name for s in specs])})

    def split(w: Workspace) -> Tables:
        rows = splitting.stratified_split(w.load("clean", "rows"), plan.key, plan.label, dict(plan.test_counts), plan.seed)
        held, y = w.figures("clean")["rows"], F.col(plan.label)
        rate = plan.test_counts.get(1, 0) / max(1, sum(plan.test_counts.values()))
        test = {f"test_rows_of_{v}": (F.count_if(y == v), float(n), float(n)) for v, n in plan.test_counts.items()} | {"test_rate": (F.avg(y), rate - 0.001, rate + 0.001)}
        of = lambda name: {f"{name}_rate_seen": (F.avg(y), 0.0, 1.0)}

        def conserved(found: Figures) -> dict[str, tuple[float, float, float]]:
            n = found["train"]["rows"] + found["test"]["rows"]
            positives = sum(found[t]["rows"] * found[t]["checks"][f"{t}_rate_seen"] for t in ("train", "test"))
            p = held["rows"] * held["checks"]["positive_rate"]
            return {"rows": (n, held["rows"], held["rows"]), "positives": (round(positives), round(p), round(p))}

        bounds = {"train_rows": (F.count("*"), float(plan.train_rows[0]), float(plan.train_rows[1]))}
        tables = {t: rows.where(F.col("split") == t).drop("split") for t in ("train", "test")}
        return Tables(tables, {"train": bounds | of("train"), "test": test | of("test")}, conserved)

    def encode(w: Workspace) -> Tables:
        train, test = w.load("split", "train"), w.load("split", "test")
        inputs = [s.name for s in plan.specs if s.name not in (plan.key, plan.label) and not s.identifier]
        counts = {r["column"]: r["distinct"] for r in encoding.cardinality(train, inputs).collect()}  # a row a column
        kinds = encoding.column_kinds(train.select(*inputs), counts, plan.kinds, plan.most_levels)
        fitted = encoding.fit_encoding(train, kinds, plan.label, plan.edges)
        named = train.sparkSession.createDataFrame(sorted(kinds.items()), "feature string, kind string")
        encoded = {"train": fitted.apply(train, [plan.key]), "test": fitted.apply(test, [plan.key])}
        if encoded["train"].schema != encoded["test"].schema:
            raise ValueError("train and test differ in their columns once encoded")
        types = dict(encoded["train"].dtypes)
        if wrong := [f"{c} ({k}) is {types[c]}" for c, k in kinds.items() if types[c] != _TYPES[k]]:
            raise ValueError("encoded columns have the wrong types: " + ", ".join(wrong))
        bins = {f"{c}_bin_out_of_range": (F.count_if(~F.col(f"{c}_bin").between(0, max(0, len(e) - 2))), 0.0, 0.0) for c, e in fitted.edges.items()}
        checks = {t: {f"{t}_{name}": check for name, check in (_no_nulls(df, df.columns) | bins).items()} for t, df in encoded.items()}
        return Tables(encoded | {"kinds": named, "kind_counts": encoding.kind_counts(named)}, checks)

    def kinds_of(w: Workspace) -> dict[str, str]:
        return {r["feature"]: r["kind"] for r in w.load("encode", "kinds").collect()}  # a row a column

    def select(w: Workspace) -> dict[str, DataFrame]:
        train, kinds = w.load("encode", "train"), kinds_of(w)
        inputs = [c for c, k in kinds.items() if k != "text"]
        ranked, right = selection.ranked(train, inputs, [], plan.label, plan.features, plan.rounds, target_rate=plan.target_rate, seed=plan.seed)
        chosen = [r["feature"] for r in ranked.orderBy("rank").collect()]
        return {"ranked": ranked, "accuracy": right} | {t: encoding.project_selected(w.load("encode", t), [plan.key, *chosen], plan.label) for t in ("train", "test")}

    def told(w: Workspace, phase: str, explainer: explaining.Explainer, described: DataFrame | None) -> DataFrame:
        train = w.load("select", "train")
        first = ordering.batches(ordering.number_rows(train, plan.key), plan.batch_rows, plan.batches)
        features = [c for c in train.columns if c not in (plan.key, plan.label)]
        if described is not None:
            first = first.join(described.select(F.col("row_id").alias(plan.key), F.col("explanation").alias("description")), plan.key)
            features.append("description")
        rows = records.as_records(first, plan.key, features, plan.label, "row_no", "batch")
        return explaining.explain_resuming(rows, f"{w.folder}/{phase}_log", explainer, size=plan.batch_rows, least=plan.reply_bounds[0], most=plan.reply_bounds[1])

    def with_calls(w: Workspace, phase: str, texts: DataFrame) -> dict[str, DataFrame]:
        return {"texts": texts, "calls": explaining.counters(w.spark, f"{w.folder}/{phase}_log")}

    def describe(w: Workspace) -> dict[str, DataFrame]:
        return with_calls(w, "describe", told(w, "describe", plan.describer, None))

    def explain(w: Workspace) -> dict[str, DataFrame]:
        return with_calls(w, "explain", told(w, "explain", plan.explainer, w.load("describe", "texts") if plan.describer else None))

    def build_graph(w: Workspace) -> Tables:
        texts = w.load("explain", "texts").withColumn("text", F.substring("explanation", 1, records.MOST_CHAIN)).where(F.length("text") >= records.LEAST_CHAIN)
        parts = triples.parts(triples.raw_matches(triples.chain_table(texts, "row_id", "text", "label"), "row_id"))
        selected = [r["feature"] for r in w.load("select", "ranked").orderBy("rank").collect()]
        found = triples.first_matches(parts, triples.canonicalise(parts, plan.phrases, plan.keywords, selected), "row_id", "label")
        edges = graph.edges(found, ("row_id", "chain", "prio", "match", "part"))
        edges = materialize(edges, "edges")
        return Tables({"edges": edges, "nodes": graph.nodes(edges)}, {"edges": {"edges": (F.count("*"), 1.0, float("inf"))}})

    def make_rules(w: Workspace) -> Tables:
        kept, skipped = graph.selected_rules(w.load("graph", "edges"), w.load("select", "ranked").select("feature"), plan.top_edges)
        made = graph.rule_templates(kept, kinds_of(w))
        fields = ["rule_id", "feature", "feature_type", "outcome", "weight", "condition_template", "mechanisms"]
        kinds = {"unsupported_kinds": (F.count_if(~F.col("feature_type").isin([*KINDS, "text"])), 0.0, 0.0)}
        return Tables({"templates": made, "skipped": skipped}, {"templates": _no_nulls(made, fields) | kinds})

    def templates(w: Workspace) -> list[Rule]:
        kind = {"text": "categorical"}
        return [Rule(r["rule_id"], r["feature"], kind.get(r["feature_type"], r["feature_type"]), r["weight"], outcome=r["outcome"], mechanisms=tuple(r["mechanisms"])) for r in w.load("rules", "templates").orderBy("pos").collect()]

    def calibrate(w: Workspace) -> dict[str, DataFrame]:
        train = w.load("select", "train")
        found = rules.calibrate(train, templates(w), plan.label, ties=plan.ties, tried=plan.tried, levels=plan.levels, most=plan.most_thresholds)
        return {"rules": combining.combine(train, found, plan.label, plan.strategy, plan.order, plan.scoring, plan.voting, plan.least_precision)}

    def evaluate(w: Workspace) -> dict[str, DataFrame]:
        test, rows = w.load("select", "test"), w.load("calibrate", "rules").orderBy("rule_index").collect()
        value = lambda r: r["threshold_num"] if r["threshold_num"] is not None else {"true": True, "false": False}.get(r["threshold_str"], r["threshold_str"])
        found = [Rule(r["rule_id"], r["feature"], r["feature_type"], r["weight"], value(r), r["rule_precision"], r["rule_support"], r["outcome"]) for r in rows]
        # strategies other than scores set no cut-off; half a point then, as in the results to match
        cutoff = rows[0]["scoring_threshold"] if rows and rows[0]["scoring_threshold"] is not None else 0.5
        metrics = evaluation.evaluate(test, found, cutoff, plan.label, plan.scoring)
        some = evaluation.examples(test, found, plan.key, plan.label)
        texts = w.load("explain", "texts").withColumnRenamed("row_id", plan.key)
        return {"metrics": metrics, "examples": some, "report": evaluation.report(metrics, found, evaluation.with_excerpts(some, texts, plan.key, "explanation"))}

    first = {"clean": clean, "split": split, "encode": encode, "select": select}
    return first | ({"describe": describe} if plan.describer else {}) | {"explain": explain, "graph": build_graph, "rules": make_rules, "calibrate": calibrate, "evaluate": evaluate}


def pipeline(raw: DataFrame, plan: Plan, folder: str) -> RulePipeline:
    return RulePipeline(Workspace(raw.sparkSession, folder), stages(raw, plan))
