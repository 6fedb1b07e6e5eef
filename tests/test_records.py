import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rulemill.operators import explaining, ordering
from rulemill.plans.pipeline import RulePipeline, Workspace
from rulemill.sources import records, tables
from rulemill.streaming import resume

GOOD = {"index": 1, "success_label": 0, "causal_cot": "a leads to b, mostly"}


def test_lines(spark, tmp_path):
    lines = [json.dumps(GOOD), "", "  ", json.dumps(GOOD | {"causal_cot": "short"}), json.dumps(GOOD | {"index": 7})]
    (tmp_path / "good.jsonl").write_text("\n".join(lines))
    assert sorted(r["index"] for r in records.read_lines(spark, str(tmp_path / "good.jsonl")).collect()) == [1, 7]
    (tmp_path / "bad.jsonl").write_text("\n".join([*lines, "{broken", '{"index": 2}']))
    with pytest.raises(PySparkException):
        records.read_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    assert records.read_lines(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 2


def test_arrays_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"f": "x", "n": 1}, {"f": "y", "n": 2}]))
    assert records.read_array(spark, str(tmp_path / "a.json"), "f string, n int").count() == 2
    df = spark.createDataFrame([("1", "a,b"), ("02", None)], "k string, v string")
    tables.write_csv(df, str(tmp_path / "csv"), one_file=True)
    assert sorted(map(tuple, tables.read_text_csv(spark, str(tmp_path / "csv"), ["k", "v"]).collect())) == [("02", None), ("1", "a,b")]
    assert dict(tables.read_text_csv(spark, str(tmp_path / "csv")).dtypes) == {"k": "string", "v": "string"}


@pytest.mark.parametrize("reply,status", [('[{"index":1,"text":"%s"}]' % ("x" * 80), "ok"), ("no", "not_array"), ('{"index":1}', "not_array"), ("[]", "wrong_count"), ('[{"index":1}]', "missing_field"), ('[{"index":5,"text":"%s"}]' % ("x" * 80), "bad_index"), ('[{"index":1,"text":"x"}]', "too_short"), ('[{"index":1,"text":"%s"}]' % ("x" * 2001), "too_long")])
def test_replies(spark, reply, status):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(records.reply_status(F.col("r"), F.array(F.lit(1).cast("long")))).first()[0] == status


def test_numbering_and_batches(spark):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("k")).repartition(5)
    got = ordering.batches(ordering.number_rows(df, "k"), 30, 3).orderBy("row_no").collect()
    keys = sorted(i * 7 % 101 for i in range(100))
    assert [r["k"] for r in got] == keys[:90] and [r["batch"] for r in got] == [i // 30 for i in range(90)]


def test_resume(spark):
    batched = spark.range(90).select("id", F.floor(F.col("id") / 30).alias("batch"))
    action = lambda n: {r["batch"]: r["action"] for r in resume.pending_batches(batched, spark.range(n), "id").collect()}
    assert action(0) == {0: "run", 1: "run", 2: "run"} and action(45) == {0: "skip", 1: "redo", 2: "run"} and action(60)[1] == "skip"
    assert resume.resume_point(spark.range(0), "id").first()[0] == -1
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k int, at int, v string")
    assert {r["k"]: r["v"] for r in resume.last_wins(rows, ["k"], "at").collect()} == {1: "new", 2: "only"}


def test_files_are_processed_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: resume.process_files(spark, source, "k int", target, state, lambda df: df.withColumn("double", F.col("k") * 2))
    spark.createDataFrame([(1,), (2,)], "k int").write.json(source)
    run()
    run()
    assert spark.read.json(target).count() == 2
    spark.createDataFrame([(3,)], "k int").write.mode("append").json(source)
    run()
    assert sorted(r["double"] for r in spark.read.json(target).collect()) == [2, 4, 6]


def test_explanations(spark):
    df = spark.createDataFrame([(i, "v", i % 2) for i in range(10)], "id long, f string, y int")
    rows = records.as_records(df, "id", ["f"], "y")
    told = explaining.explain(rows, size=3)
    assert told.where("row_id = 3").first()["explanation"] == 'Row 3 with {"f":"v"} ended in success.'
    assert explaining.attach(told, rows).count() == 10
    with pytest.raises(PySparkException):
        explaining.attach(told, rows.where("row_id < 5")).collect()
    assert explaining.attach(told, rows.where("row_id < 5"), complete=False).count() == 5


def test_failing_explainer_is_retried(spark, tmp_path):
    flag = str(tmp_path / "tried")

    def flaky(batch):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("busy")
        return ["x"] * len(batch)

    rows = spark.createDataFrame([(1, "{}", 0)], "row_id long, features_json string, label int").coalesce(1)
    assert explaining.explain(rows, flaky, wait=0.01).first()["explanation"] == "x"


@pytest.mark.parametrize(("reply", "why"), [("text", "not_list"), (["long enough"], "wrong_count"), (["long enough", None], "missing_text"), (["long enough", "x"], "too_short"), (["long enough", "y" * 50], "too_long"), (["long enough", "so it is"], None)])
def test_replies_are_checked(spark, reply, why):
    assert explaining.fault(reply, 2, 5, 20) == why
    rows = spark.createDataFrame([(1, "{}", 0), (2, "{}", 0)], "row_id long, features_json string, label int").coalesce(1)
    told = explaining.explain(rows, lambda batch: reply, tries=2, wait=0.0, least=5, most=20)
    if why:
        with pytest.raises(PySparkException, match=f"bad reply: {why}"):
            told.collect()
    else:
        assert [r["explanation"] for r in told.collect()] == reply


def test_a_rate_limit_waits_longer(monkeypatch):
    class RateLimitError(Exception):
        pass

    waits, errors = [], [RateLimitError("slow down"), OSError("busy"), OSError("status 429")]

    def explainer(batch):
        if errors:
            raise errors.pop(0)
        return ["fine"]

    monkeypatch.setattr(explaining.time, "sleep", waits.append)
    assert explaining._ask(explainer, [(1, "{}", 0)], 4, 2.0, 60.0, 1, None) == (["fine"], 4) and waits == [60.0, 2.0, 60.0]


def test_explanations_resume_by_batch(spark, tmp_path):
    """A run that stops halfway goes on where it stopped; a batch that was cut short is done again, the last one counts."""
    path, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    rows = spark.createDataFrame([(f"k{i}", "{}", 0, i, i // 4) for i in range(20)], "row_id string, features_json string, label int, row_no long, batch long")

    def explainer(stop):
        def run(batch):
            with open(calls, "a") as f:
                f.write(batch[0][0] + "\n")
            if stop in [b[0] for b in batch]:
                raise OSError("gone")
            return [f"{i} told" for i, _, _ in batch]

        return run

    with pytest.raises(RuntimeError, match="1 batches failed, the first is 3: OSError: gone"):
        explaining.explain_resuming(rows, path, explainer("k13"), at_once=1, tries=1)
    assert spark.read.json(path).where("explanation is not null").count() == 12
    # the fourth batch was cut short: one row of it is there
    asked = explaining.asked_for(rows).first()["asked"]
    spark.createDataFrame([("k12", 0, "half", 12, asked)], "row_id string, label int, explanation string, row_no long, asked long").write.mode("overwrite").json(f"{path}/batch=3")
    open(calls, "w").close()
    done = explaining.explain_resuming(rows, path, explainer(None), at_once=2)
    assert {r["row_id"]: r["explanation"] for r in done.collect()} == {f"k{i}": f"k{i} told" for i in range(20)}
    assert sorted(open(calls).read().split()) == ["k12", "k16"]
    # other features under the same rows are asked anew, and only what changed
    open(calls, "w").close()
    other = rows.withColumn("features_json", F.when(F.col("row_no") == 5, '{"a": 1}').otherwise("{}"))
    again = explaining.explain_resuming(other, path, lambda batch: [(explainer(None)(batch), f)[1] for _, f, _ in batch])
    assert again.count() == 20 and set(open(calls).read().split()) == {"k4"}
    assert explaining.counters(spark, path).first().asDict() == {"batches": 5, "failed": 0, "calls": 5, "retries": 0, "prompt_tokens": 21, "reply_tokens": 37}


def test_many_batches_are_one_job_and_failures_keep_the_rest(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(200).select("id", F.col("id").alias("row_id"), F.lit("a b").alias("features_json"), F.lit(1).alias("label"), F.col("id").alias("row_no"), F.col("id").alias("batch")).drop("id")

    def picky(batch):
        if batch[0][0] % 50 == 3:
            raise OSError("no")
        return ["x y z"] * len(batch)

    with pytest.raises(RuntimeError, match="4 batches failed, the first is 3"):
        explaining.explain_resuming(rows, path, picky, tries=2, wait=0.0)
    told = explaining.counters(spark, path).first()
    assert (told["batches"], told["failed"], told["calls"], told["retries"]) == (200, 4, 204, 4)
    done = explaining.explain_resuming(rows, path, explaining.template_explainer)
    assert done.count() == 200 and done.where("explanation = 'x y z'").count() == 196
    assert explaining.counters(spark, path).first()["failed"] == 0 and spark.read.json(path).count() == 200


def test_bad_lines_up_to_a_number(spark, tmp_path):
    path = str(tmp_path / "lines.json")
    good = '{"index": 1, "success_label": 1, "causal_cot": "a text that is long enough"}'
    open(path, "w").write("\n".join([good, "broken", "", '{"index": 2}', good]))
    assert records.read_lines(spark, path, tolerate=2).count() == 2
    with pytest.raises(ValueError):
        records.read_lines(spark, path, tolerate=1)


def test_looking_at_a_workspace(spark, tmp_path, capsys):
    from rulemill.plans import pipeline as pipeline_

    folder = str(tmp_path / "work")
    work = Workspace(spark, folder)
    work.save("a", {"t": spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), "u": spark.range(3)})
    assert {(r["table"], r["rows"], r["column"], r["nulls"]) for r in pipeline_.stage_report(work, "a").collect()} == {("t", 2, "k", 0), ("t", 2, "v", 1), ("u", 3, "id", 0)}
    pipeline_.main(["status", folder])
    assert "a: t, u" in capsys.readouterr().out
    pipeline_.main(["report", folder, "a"])
    pipeline_.main(["reset", folder, "a"])
    assert work.done() == {} and not (tmp_path / "work" / "a").exists()
    pipeline_.main(["clean", folder])
    assert not (tmp_path / "work").exists()


def test_stages_are_logged(spark, tmp_path):
    from rulemill.plans import pipeline as pipeline_

    path = str(tmp_path / "log.txt")
    pipeline_.log_to(path)
    RulePipeline(Workspace(spark, str(tmp_path / "work")), {"a": lambda w: {"t": spark.range(1)}, "b": lambda w: 1 / 0}).run()
    for handler in list(pipeline_.log.handlers):
        pipeline_.log.removeHandler(handler)
        handler.close()
    told = open(path).read()
    assert "a done after" in told and "b failed: division by zero" in told


def test_pipeline(spark, tmp_path):
    ran = []

    def stage(name, fail=False):
        def run(w):
            ran.append(name)
            if fail:
                raise RuntimeError("no")
            return {"t": spark.range(len(ran))}

        return run

    work = Workspace(spark, str(tmp_path / "work"))
    p = RulePipeline(work, {"a": stage("a"), "b": stage("b"), "c": stage("c", True), "d": stage("d")})
    assert p.run() == {"done": ["a", "b"], "pending": ["c", "d"], "errors": ["c: no"]}
    assert RulePipeline(work, {"a": stage("a"), "b": stage("b")}).run()["done"] == ["a", "b"] and ran == ["a", "b", "c"]
    p.replace_last()
    assert ran == ["a", "b", "c", "b"] and work.load("b", "t").count() == 4
    work.reset("a")
    with pytest.raises(KeyError):
        work.load("a", "t")
    assert p.run(["zzz"])["errors"][-1] == "unknown stage zzz"


def test_a_reset_takes_along_what_read_it(spark, tmp_path):
    """A stage is done while what it read is what it was: reset, run again with other rows, or with the same ones."""
    size, ran = [1], []

    def a(w):
        ran.append("a")
        return {"t": spark.range(size[0])}

    def b(w):
        ran.append("b")
        return {"t": w.load("a", "t").withColumn("twice", F.col("id") * 2)}

    def c(w):
        ran.append("c")
        return {"t": w.load("b", "t").agg(F.sum("twice").alias("s"))}

    work = Workspace(spark, str(tmp_path / "work"))
    p = RulePipeline(work, {"a": a, "b": b, "c": c, "alone": lambda w: {"t": spark.range(3)}})
    assert p.run()["pending"] == []
    assert {(r["stage"], r["same"]) for r in work.audit(p.stages).collect()} == {(s, True) for s in ("a", "b", "c", "alone")}
    size[0] = 5
    assert {r["stage"] for r in work.audit(p.stages).where("not same").collect()} == {"a"}
    ran.clear()
    work.reset("a", delete=True)
    assert work.done() == {"alone": ["t"]}
    with pytest.raises(KeyError):
        work.load("b", "t")
    assert p.run()["pending"] == [] and ran == ["a", "b", "c"]
    assert work.load("b", "t").count() == 5 and work.load("c", "t").first()["s"] == 20
    # the same rows again: what read them still holds
    ran.clear()
    work.reset("a", delete=True)
    assert p.run()["pending"] == [] and ran == ["a"]
    # one stage alone runs again with other rows: what read it is undone
    size[0] = 2
    assert p.run(["a"], resume=False)["pending"] == ["b", "c"]


def test_checks_are_observed_while_a_table_is_written(spark, tmp_path):
    from rulemill.plans.pipeline import Tables

    work, scans = Workspace(spark, str(tmp_path / "work")), spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            scans.add(len(f))
            yield f

    rows = spark.range(50).withColumn("v", F.when(F.col("id") > 4, F.col("id"))).mapInPandas(seen, "id long, v long")
    checks = {"t": {"least": (F.min("v"), 5.0, 5.0), "rows": (F.count("*"), 1.0, 60.0)}}
    work.save("a", Tables({"t": rows}, checks, lambda f: {"double": (2 * f["t"]["rows"], 100, 100)}))
    assert scans.value == 50 and work.figures("a")["t"] == {"rows": 50, "nulls": {"id": 0, "v": 5}, "checks": {"least": 5.0, "rows": 50.0}}
    with pytest.raises(ValueError, match="least = 5.0, double = 100"):
        work.save("b", Tables({"t": rows}, {"t": {"least": (F.min("v"), 6.0, 9.0)}}, lambda f: {"double": (2 * f["t"]["rows"], 0, 10)}))
    assert list(work.done()) == ["a"]
    work.save("none", Tables({"t": rows.limit(0)}, {"t": {"rows": (F.count("*"), 0.0, 0.0)}}))
    assert work.figures("none")["t"]["rows"] == 0


def test_missing_paths(spark, tmp_path):
    (tmp_path / "here").write_text("x")
    assert tables.missing_paths(spark, [str(tmp_path / "here"), str(tmp_path), str(tmp_path / "gone")]) == [str(tmp_path / "gone")]
