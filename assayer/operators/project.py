"""A project on disk: one grid file names its construct, fixture, registry and methods; runs, floors and verdicts follow from it."""

from __future__ import annotations

import importlib.util
import inspect
import json
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.errors import FixtureError, IncompleteGrid, Refusal, RuleError, RunError, StaleInput, refuse
from assayer.functions.metrics import goodness, metric
from assayer.operators import construct, freeze, methods, resolution, rules, runner
from assayer.operators.channels import Channel, Registry
from assayer.operators.costs import PriceTable
from assayer.operators.fixtures import with_source
from assayer.operators.grid import KEY, cells_frame, coverage, mixed_code, plan, require_complete, run_status
from assayer.operators.logs import append, canonical, read_log
from assayer.operators.provenance import code_state, file_digest, read_artifact, write_artifact
from assayer.operators.resample import weighted_once
from assayer.sources.tables import PREDICTIONS, columns_of, read_source

NEEDED, ALLOWED = ("construct", "fixture", "registry", "methods"), ("fixtures_dir", "channel_manifest", "methods_module", "tasks", "split_keys", "fit_seeds", "threads", "prices", "out")
ASKED = ("grid", "resolution", "questions")


def load_yaml(path: str | Path, kind: type[Refusal]) -> dict:
    path = Path(path)
    refuse(kind, [] if path.is_file() else [f"there is no file {path}"])
    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    refuse(kind, [] if isinstance(raw, Mapping) else [f"{path} does not hold a mapping"])
    return dict(raw)


def load_module(path: str | Path) -> object:
    """Run a project's module once in this process, so that it can register methods or rules."""
    path = Path(path).resolve()
    name = f"assayer_project_{file_digest(path)[:16]}"
    if name not in sys.modules:
        spec = importlib.util.spec_from_file_location(name, path)
        sys.modules[name] = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(sys.modules[name])
        except BaseException:
            del sys.modules[name]
            raise
    return sys.modules[name]


def load_registry(path: str | Path) -> Registry:
    raw, own = load_yaml(path, RunError), ("kind", "columns", "tasks")
    found = Registry([Channel(n, c["kind"], c.get("columns") or [], {k: v for k, v in c.items() if k not in own}, c.get("tasks")) for n, c in raw["channels"].items()], raw.get("ignore") or {})
    refuse(RunError, found.problems())
    return found


def locate(path: str | Path, folder: str | Path) -> Path:
    """The frozen fixture that a specification, as it and its construct are now, gave; a folder is one already."""
    path = Path(path).resolve()
    if path.is_dir():
        return path
    raw = load_yaml(path, FixtureError)
    now, stated = json.loads(json.dumps(raw, default=str)), file_digest(path.parent / raw.get("construct", "construct.yaml"))
    for m in sorted(Path(folder).glob("*/manifest.json")):
        found = json.loads(m.read_text(encoding="utf-8"))
        if canonical(found["spec"]) == canonical(now) and found["construct_sha256"] == stated:
            return m.parent
    raise FixtureError(f"{path} has no frozen fixture in {folder}, as it and its construct stand; freeze it")


@dataclass
class Project:
    """What a grid file names, read and checked against one another."""

    path: Path
    raw: dict
    stated: dict
    fixture: Path
    manifest: dict
    tables: dict[str, DataFrame]
    registry: Registry
    prices: PriceTable | None
    code: str

    @property
    def base(self) -> Path:
        return self.path.parent

    @property
    def out(self) -> Path:
        return self.base / self.raw.get("out", "runs")

    @property
    def tasks(self) -> list[str]:
        return list(self.raw.get("tasks") or self.manifest["tasks"])

    @property
    def split_keys(self) -> list[str]:
        return list(self.raw.get("split_keys") or self.manifest["spec"]["split"]["keys"][:1])

    @property
    def seeds(self) -> list[int]:
        return list(self.raw.get("fit_seeds") or [0])

    @property
    def metric(self) -> str:
        return self.stated["metric"]["name"]

    def cells(self, task: str) -> list[str]:
        return list(self.manifest["tasks"][task]["meta"]["cells"])

    def classes(self, task: str) -> int:
        """How many classes a task's frozen labels have: two, or one more than the largest label."""
        if self.manifest["spec"]["tasks"][task]["type"] == "binary":
            return 2
        return 1 + max(int(k.rsplit("/", 1)[1]) for k in self.manifest["tasks"][task]["meta"]["classes"])

    def planned(self, spark: SparkSession) -> DataFrame:
        return plan(cells_frame(spark, [(t, c) for t in self.tasks for c in self.cells(t)]), self.raw["methods"], self.split_keys, self.seeds)

    def records(self, spark: SparkSession) -> DataFrame:
        """Every run's record, as read from the folder of records."""
        rows = [json.loads(p.read_text(encoding="utf-8")) for p in sorted((self.out / "records").rglob("*.json"))] if self.out.exists() else []
        names = [f.split()[0] for f in runner.RECORD.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], runner.RECORD)

    def predictions(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PREDICTIONS).parquet(str(self.out / "predictions"))

    def inputs(self) -> dict[str, Path]:
        found = {"grid": self.path, "fixture": self.fixture / "manifest.json", "registry": self.base / self.raw["registry"]}
        return found | ({"prices": self.base / self.raw["prices"]} if "prices" in self.raw else {})


def prepare(spark: SparkSession, path: str | Path) -> Project:
    """Read all that a grid names and refuse it, with everything that is wrong, before anything runs."""
    path = Path(path).resolve()
    raw = load_yaml(path, RunError)
    problems = [f"the grid needs {k}" for k in NEEDED if not raw.get(k)] + [f"unknown key {k!r}" for k in raw if k not in (*NEEDED, *ALLOWED)]
    refuse(RunError, problems)
    base, stated = path.parent, construct.load(path.parent / raw["construct"])
    folder = locate(base / raw["fixture"], base / raw.get("fixtures_dir", "fixtures"))
    manifest, tables = freeze.load(spark, folder)
    if manifest["construct_sha256"] != file_digest(base / raw["construct"]):
        problems.append("the fixture was frozen under another construct; freeze it again")
    registry = load_registry(base / raw["registry"])
    if "methods_module" in raw:
        load_module(base / raw["methods_module"])
    problems += [f"unknown method {m!r}; there are {', '.join(sorted(methods.REGISTRY))}" for m in raw["methods"] if m not in methods.REGISTRY]
    problems += [f"task {t!r} is not in the fixture" for t in raw.get("tasks") or [] if t not in manifest["tasks"]]
    problems += [f"split key {k!r} was not frozen" for k in raw.get("split_keys") or [] if k not in manifest["spec"]["split"]["keys"]]
    if raw.get("channel_manifest"):
        checked = read_artifact(base / raw["channel_manifest"])
        if checked["fixture"] != manifest["digest"]:
            problems.append("the channel manifest was checked against another fixture")
    refuse(RunError, problems)
    prices = PriceTable.from_dict(load_yaml(base / raw["prices"], RunError)) if "prices" in raw else None
    return Project(path, raw, stated, folder, manifest, tables, registry, prices, code_state(base)["digest"])


def source(spark: SparkSession, project: Project, task: str) -> DataFrame:
    """A task's assignments beside their source columns, all of which must be registered."""
    spec = project.manifest["spec"]
    at = Path(project.manifest["spec_path"]).parent / project.manifest["tasks"][task]["source"]
    rows, df = project.tables[task], read_source(spark, str(at), spec["id_column"])
    return with_source(rows, df, spec["id_column"])


def check_channels(spark: SparkSession, registry: str | Path, fixture: str | Path, folder: str | Path, out: str | Path) -> dict:
    """Check every source column of a fixture against the registry and write the manifest of channels."""
    found, at = load_registry(registry), locate(fixture, folder)
    manifest, _ = freeze.load(spark, at)
    spec, parts = manifest["spec"], {}
    for name, part in manifest["tasks"].items():
        columns = columns_of(spark, str(Path(manifest["spec_path"]).parent / part["source"]))
        task = spec["tasks"][name]
        rule = task["label_rule"]
        labels = task.get("label_columns") or ([rule["column"]] if "column" in rule else [])
        found.check(columns, labels, [c for c in (spec["id_column"], spec.get("cluster_column"), task.get("cell_by")) if c])
        parts[name] = found.manifest(name, columns)
    write_artifact(out, {"fixture": manifest["digest"], "tasks": parts}, Path(out).resolve().parent, {"registry": registry, "fixture": at / "manifest.json"})
    return parts


def run(spark: SparkSession, path: str | Path, rerun_stale: bool = False) -> DataFrame:
    """Run what is open of a grid. Each run's record and line of history is on disk before the next begins, so a broken-off grid goes
    on where it stopped. Returns the coverage."""
    project = prepare(spark, path)
    history = project.out.parent / f"{project.out.name}.history.jsonl"

    def keep(record: dict) -> None:
        name = "__".join(str(record[k]).replace("/", "--") for k in KEY)
        write_artifact(project.out / "records" / f"{name}.json", {k: v for k, v in record.items()}, project.base, project.inputs())
        append(history, {"run": name, "task": record["task"], "status": record["status"], "code_state": project.code})

    for task in project.tasks:
        spec = runner.Grid(task, project.cells(task), project.raw["methods"], project.split_keys, project.seeds, project.registry, project.metric, project.classes(task))
        runner.run_grid(spark, source(spark, project, task), spec, project.records(spark).where(F.col("task") == task), str(project.out / "predictions"), project.code, rerun_stale, keep, int(project.raw.get("threads", 4)))
    return status(spark, path)


def status(spark: SparkSession, path: str | Path) -> DataFrame:
    project = prepare(spark, path)
    return coverage(run_status(project.planned(spark), project.records(spark), project.code))


def _complete(spark: SparkSession, project: Project) -> DataFrame:
    """The records of a grid without open, failed or stale runs, all written under one state of the code."""
    records = project.records(spark)
    require_complete(run_status(project.planned(spark), records, project.code))
    refuse(IncompleteGrid, ["the records come from more than one state of the code"] if mixed_code(records).limit(1).count() else [])
    return records


def resolve(spark: SparkSession, path: str | Path, out: str | Path | None = None, draws: int = 1000, threshold: float = resolution.THRESHOLD, only: Sequence[str] | None = None) -> dict:
    """The floor of each cell, by the methods but majority (or ``only`` some), written as an artifact."""
    project = prepare(spark, path)
    records = _complete(spark, project).where("status = 'ok'")
    chosen = list(only or [m for m in project.raw["methods"] if m != "majority"])
    refuse(RunError, [f"method {m!r} is not in the grid" for m in chosen if m not in project.raw["methods"]])
    scores = records.where(F.col("method").isin(chosen)).select("cell", "method", "split_key", F.col("fit_seed").alias("seed"), F.col("score_test").alias("score"))
    # the primary run of a method is that of the first split key and seed
    primary = (F.col("split_key") == project.split_keys[0]) & (F.col("fit_seed") == project.seeds[0])
    tested = project.predictions(spark).where("split = 'test'").where(F.col("method").isin(chosen) & primary).withColumnRenamed("fit_seed", "seed")
    floors = {r["cell"]: r.asDict() for r in resolution.resolve(scores, tested, project.metric, draws, threshold).collect()}
    refuse(RunError, [f"no floor was measured for {c}" for t in project.tasks for c in project.cells(t) if floors.get(c, {}).get("floor") is None])
    sizes = {r["cell"]: r.asDict() for r in resolution.test_sizes(tested.where(F.col("method") == chosen[0])).collect()}
    found = {"fixture": project.manifest["digest"], "metric": project.metric, "draws": draws, "threshold": threshold, "cells": {c: f | sizes.get(c, {}) for c, f in floors.items()}}
    write_artifact(out or project.base / "resolution.json", found, project.base, project.inputs())
    return found


# Questions


def _named(spec: object) -> list[str] | None:
    """The methods that a question's side may turn out to be: a name, {select: [...]} or {oracle_select: [...]}."""
    if isinstance(spec, str):
        return [spec]
    if isinstance(spec, Mapping) and len(spec) == 1 and next(iter(spec)) in ("select", "oracle_select"):
        found = next(iter(spec.values()))
        return [str(x) for x in found] if isinstance(found, list) and found else None
    return None


def load_questions(path: str | Path) -> dict:
    """A questions file, refused with all that is wrong: its own keys, and each question's rule and parameters."""
    path = Path(path)
    raw = load_yaml(path, RuleError)
    if "rules_module" in raw:
        load_module(path.parent / raw["rules_module"])
    problems = [f"the questions file needs {k}" for k in ASKED if not raw.get(k)] + [f"unknown key {k!r}" for k in raw if k not in (*ASKED, "rules_module")]
    seen = []
    for n, q in enumerate(raw.get("questions") or [], 1):
        if not isinstance(q, Mapping):
            problems.append(f"question {n} must be a mapping")
            continue
        problems += [f"question {n} needs {k}" for k in ("id", "question", "rule", "params") if q.get(k) in (None, "")]
        problems += [f"question {q['id']!r} appears more than once"] if q.get("id") in seen else []
        seen.append(q.get("id"))
        rule = rules.RULES.get(q.get("rule"))
        if rule is None or rule.ask is None:
            problems.append(f"question {q.get('id')}: there is no rule {q.get('rule')!r} for questions")
        elif isinstance(q.get("params"), Mapping):
            taken = list(inspect.signature(rule.ask).parameters.values())[1:]
            problems += [f"question {q.get('id')}: {rule.name} needs {p.name}" for p in taken if p.default is p.empty and p.name not in q["params"]]
            problems += [f"question {q.get('id')}: {rule.name} takes no {k}" for k in q["params"] if k not in {p.name for p in taken}]
    refuse(RuleError, problems)
    return raw


def check_questions(spark: SparkSession, path: str | Path) -> tuple[dict, Project]:
    """The questions and their grid; cells and methods that a question names must be in it."""
    raw = load_questions(path)
    project = prepare(spark, Path(path).parent / raw["grid"])
    cells, problems = {c for t in project.tasks for c in project.cells(t)}, []
    for q in raw["questions"]:
        named = [q["params"][k] for k in ("cell",) if k in q["params"]] + list(q["params"].get("cells") or [])
        problems += [f"question {q['id']}: {c!r} is no cell of the grid" for c in named if c not in cells]
        for side in ("a", "b", "model", "reference"):
            if side in q["params"]:
                found = _named(q["params"][side])
                problems += [f"question {q['id']}: {side} must be a method, select or oracle_select"] if found is None else []
                problems += [f"question {q['id']}: method {m!r} is not in the grid" for m in found or [] if m not in project.raw["methods"]]
    refuse(RuleError, problems)
    return raw, project


def snapshot(question: Mapping) -> dict:
    """What a claim pins of its question."""
    return {k: question[k] for k in ("question", "rule", "params")}


@dataclass
class Context:
    """What a rule may ask of a complete grid. Selections read validation scores alone; one that reads test scores marks the verdict."""

    spark: SparkSession
    project: Project
    records: DataFrame
    floors: Mapping[str, Mapping]
    selections: list[dict] = field(default_factory=list)
    oracle: bool = False

    @property
    def metric(self) -> str:
        return self.project.metric

    def floor(self, cell: str) -> float:
        found = (self.floors.get(cell) or {}).get("floor")
        refuse(RuleError, [f"no floor was measured for {cell}"] if found is None else [])
        return found

    def floor_frame(self, cells: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(c, float(self.floor(c))) for c in cells], "cell string, floor double")

    def test_rows(self, cell: str, method: str) -> DataFrame:
        """(id, cell, cluster, label, score, arm) of a method's primary run over a cell's test rows."""
        p = self.project
        mine = (F.col("cell") == cell) & (F.col("method") == method) & (F.col("split_key") == p.split_keys[0]) & (F.col("fit_seed") == p.seeds[0]) & (F.col("split") == "test")
        task = next(t for t in p.tasks if cell in p.cells(t))
        found = p.predictions(self.spark).where(mine).select("id", "cell", "cluster", "label", "score")
        return found.join(p.tables[task].select("id", "arm"), "id")

    def paired(self, cell: str, a: str, b: str) -> DataFrame:
        return rules.pair(self.test_rows(cell, a), self.test_rows(cell, b).drop("arm"))

    def select(self, cell: str, candidates: Sequence[str]) -> str:
        """The candidate with the best mean validation score over all keys and seeds."""
        rows = self.records.where((F.col("cell") == cell) & F.col("method").isin(list(candidates))).select("cell", "method", F.col("score_validation").alias("score"))
        return self._chosen(cell, candidates, rules.best(rules.mean_validation(rows, self.metric)), "validation")

    def oracle_select(self, cell: str, candidates: Sequence[str]) -> str:
        """The candidate with the best test score: an upper bound that can't confirm a claim."""
        self.oracle = True
        rows = None
        for m in candidates:
            own = weighted_once(self.test_rows(cell, m).withColumn("method", F.lit(m)))
            rows = own if rows is None else rows.unionByName(own)
        values = metric(self.metric)(rows, ["cell", "method"]).withColumn("value", goodness(self.metric, F.col("value")))
        return self._chosen(cell, candidates, rules.best(values), "test")

    def _chosen(self, cell: str, candidates: Sequence[str], found: DataFrame, on: str) -> str:
        first = found.first()
        refuse(RuleError, [] if first else [f"no candidate has a {on} score in {cell}"])
        self.selections.append({"cell": cell, "candidates": list(candidates), "chosen": first["method"], "on": on})
        return first["method"]

    def method(self, cell: str, spec: object) -> str:
        refuse(RuleError, [] if _named(spec) else [f"{spec!r} names no method"])
        if isinstance(spec, str):
            return spec
        (kind, candidates), = spec.items()
        return (self.select if kind == "select" else self.oracle_select)(cell, candidates)


def decide(spark: SparkSession, path: str | Path, out: str | Path | None = None, draws: int = rules.DRAWS) -> dict:
    """Answer every question of a file: check it, pass the rules in use through the null-input test, then run each on the grid."""
    path = Path(path).resolve()
    raw, project = check_questions(spark, path)
    records = _complete(spark, project)
    at = path.parent / raw["resolution"]
    floors = read_artifact(at)
    refuse(StaleInput, ["the floors were measured on another fixture"] if floors["fixture"] != project.manifest["digest"] else [])
    suite_at, names = path.parent / "null_suite.json", sorted({q["rule"] for q in raw["questions"]})
    try:
        known = read_artifact(suite_at, project.base)["rules"] if suite_at.exists() else {}
    except StaleInput:
        known = {}
    suite = rules.gate(spark, names, draws, known)
    write_artifact(suite_at, {"rules": known | suite}, project.base, {})
    verdicts = []
    for q in raw["questions"]:
        context = Context(spark, project, records, floors["cells"])
        found = rules.RULES[q["rule"]].ask(context, **q["params"])
        verdicts.append({"id": q["id"], **snapshot(q), **found, "rule_sha": rules.RULES[q["rule"]].source_sha, "selections": context.selections, "oracle": context.oracle, "snapshot": snapshot(q)})
    payload = {"metric": project.metric, "null_suite": {n: suite[n] for n in names}, "verdicts": verdicts}
    write_artifact(out or path.parent / "verdicts.json", payload, project.base, {"questions": path, "resolution": at, "null_suite": suite_at, "records": project.out / "records"})
    return payload


def first_run(project: Project) -> str | None:
    """When the first run of the grid was recorded, by its history."""
    found = read_log(project.out.parent / f"{project.out.name}.history.jsonl")
    return min((e["recorded_at"] for e in found), default=None)
