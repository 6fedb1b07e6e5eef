import json
import random

from pyspark.sql import functions as F

from rulemill.plans.engine import Plan, pipeline
from rulemill.spec import FeatureSpec


def causal(batch):
    """Names a feature's effect whenever its value stands out."""
    out = []
    for _, features, label in batch:
        f = json.loads(features)
        told = [f"high {c} → more reach → {'success' if label else 'failure'}" for c in ("years", "level") if float(f[c]) >= 3]
        out.append("; ".join(told) or "nothing stands out → unclear")
    return out


def raw_table(spark, n=600):
    rng = random.Random(0)
    rows = []
    for i in range(n):
        years, level, flag = rng.randint(0, 120) / 6, rng.randint(1, 5), rng.random() < 0.5
        y = rng.random() < (0.8 if years > 12 and level >= 4 else 0.1)
        rows.append((str(i), "NA" if i % 37 == 0 else f"{years:.3f}", str(level), str(int(flag)), rng.choice(["a", "b"]), str(int(y)), f"name {i}"))
    return spark.createDataFrame(rows, "id string, years string, level string, flag string, place string, y string, name string")


SPECS = [FeatureSpec("id", identifier=True), FeatureSpec("years", "continuous", 0.0), FeatureSpec("level", "ordinal"), FeatureSpec("flag", "binary"), FeatureSpec("place"), FeatureSpec("y", "binary")]


def plan(specs=SPECS, **how):
    how = {"explainer": causal, "rounds": 3, "features": 4, "batches": 5} | how
    return Plan(specs, "id", "y", {1: 20, 0: 80}, {"years": "years", "level": "level"}, **how)


def test_raw_table_to_report(spark, tmp_path):
    p = pipeline(raw_table(spark), plan(), str(tmp_path / "work"))
    status = p.run()
    assert status["errors"] == [] and status["pending"] == []
    m = p.workspace.load("evaluate", "metrics").first()
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == 100 and m["tp"] + m["fn"] == 20
    assert m["precision"] > 0.2  # better than calling every row: a third of the positives here are noise
    lines = [r["line"] for r in p.workspace.load("evaluate", "report").orderBy("line_no").collect()]
    assert lines[0] == "# Rule evaluation" and any("| years |" in x or "| level |" in x for x in lines)
    assert p.workspace.load("rules", "templates").count() >= 2
    right = p.workspace.load("select", "accuracy").first()
    assert right["rows"] == 500 and right["accuracy"] == right["right"] / 500 > 0.5
    assert {r["kind"]: r["n"] for r in p.workspace.load("encode", "kind_counts").collect()}["continuous"] == 1
    # a second run finds everything done
    assert p.run()["pending"] == []
    # another strategy from the same calibrated rules
    other = pipeline(raw_table(spark), plan(strategy="ensemble", voting="weighted"), str(tmp_path / "work"))
    assert other.run(["calibrate", "evaluate"], resume=False)["errors"] == []
    assert other.workspace.load("calibrate", "rules").where("scoring_threshold is null").count() >= 1


def test_a_column_of_names_and_two_phases(spark, tmp_path):
    """Over a thousand names are encoded, and each explanation can read what was told about its row before."""

    def describer(batch):
        return [f"row {i} is told of" for i, _, _ in batch]

    def reader(batch):
        assert all("is told of" in json.loads(f)["description"] for _, f, _ in batch)
        return causal(batch)

    p = pipeline(raw_table(spark, 1500), plan([*SPECS, FeatureSpec("name")], describer=describer, explainer=reader, features=5), str(tmp_path / "work"))
    names = ["clean", "split", "encode", "select", "describe", "explain", "graph"]
    assert p.run(names)["errors"] == []
    assert p.workspace.load("encode", "train").agg({"name": "max"}).first()[0] == 1399
    assert p.workspace.load("explain", "texts").count() == 150


def test_checks_stop_the_run(spark, tmp_path):
    raw = raw_table(spark, 150)
    errors = lambda raw, plan, where: pipeline(raw, plan, str(tmp_path / where)).run()["errors"][0]
    assert "lacks years" in errors(raw.drop("years"), plan(), "a")
    assert "rows = 150" in errors(raw, plan(least_rows=1000), "b")
    assert "test_rows_of_1" in errors(raw.withColumn("y", F.lit("0")), plan(), "c")
    assert "too_short" in errors(raw, plan(explainer=lambda batch: ["x"] * len(batch), reply_bounds=(70, 2000)), "d")


def test_settings_and_bounds(spark, tmp_path):
    """Other imputation, casts, levels, candidates and ties; bounds on rates and rows stop the run."""
    how = {"imputation": {"continuous": "mean", "ordinal": "mode"}, "casts": {"continuous": "double"}, "most_levels": 3, "ties": "lowest_threshold", "tried": "percentiles", "positive_rate": (0.1, 0.5)}
    p = pipeline(raw_table(spark), plan(**how), str(tmp_path / "a"))
    assert p.run()["errors"] == []
    assert dict(p.workspace.load("clean", "rows").dtypes)["years"] == "double"
    assert {r["feature"]: r["kind"] for r in p.workspace.load("encode", "kinds").collect()}["level"] == "continuous"  # five values are over three
    assert p.workspace.load("calibrate", "rules").count() >= 1
    calls = p.workspace.load("explain", "calls").first()
    assert (calls["batches"], calls["calls"], calls["retries"]) == (5, 5, 0) and calls["reply_tokens"] > 0
    assert p.workspace.figures("clean")["rows"]["rows"] == 600
    # a reset of the explanations deletes their log too
    p.workspace.reset("explain", delete=True)
    assert not (tmp_path / "a" / "explain_log").exists() and "rules" not in p.workspace.done() and "select" in p.workspace.done()
    error = lambda where, **how: pipeline(raw_table(spark), plan(**how), str(tmp_path / where)).run(["clean", "split"])["errors"][0]
    assert "positive_rate = " in error("b", positive_rate=(0.9, 1.0))
    assert "train_rows = 500" in error("c", train_rows=(7000, 9000))
    assert "imputation can't be median of binary" in error("d", imputation={"binary": "median"})


def test_the_raw_table_is_read_once(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            scans.add(len(f))
            yield f

    raw = raw_table(spark, 300)
    counted = raw.mapInPandas(seen, raw.schema)
    assert pipeline(counted, plan(), str(tmp_path / "work")).run(["clean"])["errors"] == []
    assert scans.value == 300
