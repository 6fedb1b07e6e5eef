"""Stages in order over a workspace of tables, with a manifest of what is done."""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.tables import remove

log = logging.getLogger("rulemill")

#: What a check looks at in a table that is being written: an aggregate, and the range it must lie in.
Checks = dict[str, tuple[Column, float, float]]
Figures = dict[str, dict[str, object]]


@dataclass
class Tables:
    """What a stage makes: tables, checks of single ones, and checks of the figures of several.

    Checks are observed while a table is written, so they cost no pass of their own. across gets rows and checked values
    of each table and returns the values to check with their ranges.
    """

    tables: dict[str, DataFrame]
    checks: dict[str, Checks] = field(default_factory=dict)
    across: Callable[[Figures], dict[str, tuple[float, float, float]]] | None = None


Stage = Callable[["Workspace"], "dict[str, DataFrame] | Tables"]


class CheckFailed(ValueError):
    """What a stage wrote isn't as it must be."""


def _failed(values: dict[str, tuple[object, float, float]]) -> list[str]:
    return [f"{name} = {value}" for name, (value, low, high) in values.items() if value is None or not low <= float(value) <= high]


class Workspace:
    """Tables below one folder; a stage's tables count once the manifest names the stage as done.

    The manifest notes a digest of each table, taken from its rows while they are written, and the digests of the
    tables that a stage read. A stage is done only while all that it read is still what it was, so a stage that is reset
    or runs again with another result takes all stages that read it along.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, str] = {}

    def _events(self) -> list[dict]:
        try:
            rows = self.spark.read.text(f"{self.folder}/manifest").collect()
        except AnalysisException:
            return []
        return sorted((json.loads(r[0]) for r in rows), key=lambda e: e["at"])

    def _note(self, **event: object) -> None:
        self.spark.createDataFrame([(json.dumps(event | {"at": time.time()}),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/manifest")

    def _current(self) -> dict[str, dict]:
        """The last event of each stage that is done, in order."""
        last: dict[str, dict] = {}
        for e in self._events():
            last.pop(e["stage"], None)
            if e["what"] == "done":
                last[e["stage"]] = e
        known: dict[str, bool] = {}

        def holds(stage: str) -> bool:
            if stage not in known:
                known[stage] = False  # a stage that reads itself never holds
                e = last.get(stage)
                known[stage] = e is not None and all(
                    holds(read.split("/", 1)[0]) and last[read.split("/", 1)[0]].get("digests", {}).get(read.split("/", 1)[1]) == digest for read, digest in e.get("reads", {}).items()
                )
            return known[stage]

        return {stage: e for stage, e in last.items() if holds(stage)}

    def done(self) -> dict[str, list[str]]:
        """The tables of each stage that is done, in order."""
        return {stage: e["tables"] for stage, e in self._current().items()}

    def figures(self, stage: str) -> Figures:
        """What was observed of each table while it was written: rows, nulls by column, and the checked values."""
        return self._current().get(stage, {}).get("figures", {})

    def begin(self) -> None:
        """From now on, tables that are loaded count as read by the stage that is saved next."""
        self._read = {}

    def save(self, stage: str, made: dict[str, DataFrame] | Tables) -> None:
        """Writes the tables, observes them meanwhile, and notes the stage as done if all checks passed."""
        made = made if isinstance(made, Tables) else Tables(made)
        figures: Figures = {}
        digests: dict[str, str] = {}
        values: dict[str, tuple[object, float, float]] = {}
        for name, df in made.tables.items():
            checks = made.checks.get(name, {})
            nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null {i}") for i, c in enumerate(df.columns)]
            content = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")) if df.columns else F.count("*")
            seen = Observation()
            observed = df.observe(seen, F.count("*").alias("rows"), content.alias("content"), *nulls, *[v[0].cast("double").alias(f"check {k}") for k, v in checks.items()])
            observed.write.mode("overwrite").parquet(f"{self.folder}/{stage}/{name}")
            got = seen.get or {}
            if "rows" not in got:  # nothing is observed where Spark knows that there is nothing
                stored = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{stage}/{name}")
                got = stored.agg(F.count("*").alias("rows"), content.alias("content"), *nulls, *[v[0].cast("double").alias(f"check {k}") for k, v in checks.items()]).first().asDict()
            digests[name] = hashlib.sha256(repr((got["rows"], str(got["content"]), df.schema.simpleString())).encode()).hexdigest()
            figures[name] = {"rows": got["rows"], "nulls": {c: got[f"null {i}"] for i, c in enumerate(df.columns)}, "checks": {k: got[f"check {k}"] for k in checks}}
            values |= {k: (got[f"check {k}"], low, high) for k, (_, low, high) in checks.items()}
        if made.across:
            values |= made.across(figures)
        if failed := _failed(values):
            raise CheckFailed("checks failed: " + ", ".join(failed))
        self._note(what="done", stage=stage, tables=sorted(made.tables), digests=digests, reads=self._read, figures=figures)
        self.begin()

    def load(self, stage: str, name: str) -> DataFrame:
        e = self._current().get(stage, {})
        if name not in e.get("tables", []):
            raise KeyError(f"{stage}/{name} isn't there")
        self._read[f"{stage}/{name}"] = e.get("digests", {}).get(name)
        return self.spark.read.parquet(f"{self.folder}/{stage}/{name}")

    def reset(self, stage: str, delete: bool = False) -> None:
        """Forgets a stage, and with it all that read its tables; deletes its tables and its log of replies if asked for."""
        self._note(what="reset", stage=stage)
        if delete:
            remove(self.spark, f"{self.folder}/{stage}")
            remove(self.spark, f"{self.folder}/{stage}_log")

    def clean_all(self) -> None:
        """Deletes all tables, logs of replies and the manifest."""
        remove(self.spark, self.folder)

    def audit(self, stages: dict[str, Stage]) -> DataFrame:
        """stage, table, same: whether what is stored is what the stages make now from what they read.

        Each stage that is done is computed again and its rows are compared with the stored ones by count and content.
        Tables that a run orders or samples anew differ; so do texts of an explainer that isn't repeatable.
        """
        rows = []
        for stage, e in self._current().items():
            if stage not in stages:
                continue
            again = stages[stage](self)
            for name, df in (again.tables if isinstance(again, Tables) else again).items():
                got = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("s")).first()
                digest = hashlib.sha256(repr((got["n"], str(got["s"]), df.schema.simpleString())).encode()).hexdigest()
                rows.append((stage, name, digest == e["digests"].get(name)))
        self.begin()
        return self.spark.createDataFrame(rows, "stage string, table string, same boolean")


@dataclass
class RulePipeline:
    """Named stages, run in order; the first failure stops the run and is reported."""

    workspace: Workspace
    stages: dict[str, Stage]
    errors: list[str] = field(default_factory=list)

    def run(self, names: list[str] | None = None, resume: bool = True) -> dict[str, object]:
        for name in names or list(self.stages):
            if name not in self.stages:
                self.errors.append(f"unknown stage {name}")
                continue
            if resume and name in self.workspace.done():  # asked each time: a stage that ran again may have undone it
                continue
            began = time.monotonic()
            log.info("%s begins", name)
            try:
                self.workspace.begin()
                self.workspace.save(name, self.stages[name](self.workspace))
            except Exception as e:  # reported in the status, as the caller can't tell which stage ran
                log.error("%s failed: %s", name, e)
                self.errors.append(f"{name}: {e}")
                break
            log.info("%s done after %.1f s", name, time.monotonic() - began)
        return self.status()

    def replace_last(self) -> dict[str, object]:
        """Runs the last finished stage again."""
        done = list(self.workspace.done())
        if done:
            self.workspace.reset(done[-1])
        return self.run(done[-1:])

    def status(self) -> dict[str, object]:
        done = self.workspace.done()
        return {"done": list(done), "pending": [s for s in self.stages if s not in done], "errors": list(self.errors)}


def log_to(path: str | None = None) -> None:
    """Logs of the stages to the standard output, and to a file if one is given."""
    for handler in [logging.StreamHandler(sys.stdout), *([logging.FileHandler(path)] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.INFO)


def stage_report(workspace: Workspace, stage: str) -> DataFrame:
    """table, rows, column, nulls of each table that a stage wrote, as observed while it was written."""
    found = workspace.figures(stage)
    if not found:
        raise KeyError(f"{stage} isn't there")
    rows = [(name, f["rows"], column, nulls) for name, f in found.items() for column, nulls in f["nulls"].items()]
    return workspace.spark.createDataFrame(rows, "table string, rows long, column string, nulls long")


def main(args: list[str] | None = None) -> int:
    """Looks at a workspace and resets it: python -m rulemill.plans.pipeline status|report|reset|clean FOLDER [STAGE]."""
    parser = argparse.ArgumentParser(prog="rulemill.plans.pipeline", description=main.__doc__)
    parser.add_argument("what", choices=["status", "report", "reset", "clean"])
    parser.add_argument("folder")
    parser.add_argument("stage", nargs="?")
    asked = parser.parse_args(args)
    if asked.what in ("report", "reset") and not asked.stage:
        parser.error("which stage?")
    workspace = Workspace(SparkSession.builder.getOrCreate(), asked.folder)
    if asked.what == "status":
        print("\n".join(f"{stage}: {', '.join(tables)}" for stage, tables in workspace.done().items()) or "nothing is done")
    elif asked.what == "report":
        stage_report(workspace, asked.stage).show(1000, truncate=False)
    elif asked.what == "reset":
        workspace.reset(asked.stage, delete=True)
    else:
        workspace.clean_all()
    return 0


if __name__ == "__main__":
    sys.exit(main())
