"""Fixtures frozen under their content: the same content comes back, a changed one is refused."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import replace
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.errors import FixtureError, StaleInput, refuse
from assayer.operators import construct, fixtures
from assayer.operators.fixtures import Arm, Spec
from assayer.operators.logs import canonical, now
from assayer.operators.provenance import file_digest, write_atomic
from assayer.sources.tables import content_digest, read_source

TOP, TASK = {"construct", "id_column", "cluster_column", "tasks", "split", "cutoffs", "arms"}, {"source", "type", "label_rule", "label_columns", "cell_by"}


def _validation(split: Mapping) -> object:
    """A share, by itself or as {fraction: share}."""
    found = split.get("validation")
    return found["fraction"] if isinstance(found, Mapping) and set(found) == {"fraction"} else found


def spec_problems(raw: Mapping, stated: Mapping) -> list[str]:
    """Everything wrong with a fixture specification, against its construct."""
    out = [f"unknown key {k!r}" for k in raw if k not in TOP] + [f"the specification needs {k}" for k in ("construct", "id_column", "tasks", "split") if not raw.get(k)]
    known = {t["name"] for t in stated["tasks"]}
    for name, t in (raw.get("tasks") or {}).items():
        out += [f"task {name} is not in the construct statement"] if name not in known else []
        out += [f"task {name}: unknown key {k!r}" for k in t if k not in TASK] + [f"task {name} needs {k}" for k in ("source", "type", "label_rule") if not t.get(k)]
        if t.get("type") not in ("binary", "multiclass"):
            out.append(f"task {name}: type must be binary or multiclass")
        rule = t.get("label_rule")
        called = isinstance(rule, Mapping) and set(rule) == {"function"} and str(rule["function"]).count(":") == 1
        if not (called or isinstance(rule, Mapping) and "column" in rule and set(rule) <= {"column", "map"}):
            out.append(f"task {name}: label_rule must be {{column}}, {{column, map}} or {{function: module.py:name}}")
        if called and not t.get("label_columns"):
            out.append(f"task {name}: a function needs label_columns, the columns that it reads")
    split = raw.get("split") or {}
    test, keys = split.get("test") or {}, split.get("keys") or []
    share = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and 0 < x < 1
    if not (set(test) == {"fraction", "key"} and share(test["fraction"]) or set(test) == {"column", "value"}):
        out.append("split.test must be {fraction, key} with a fraction between 0 and 1, or {column, value}")
    if not share(_validation(split)):
        out.append("split.validation must be a fraction between 0 and 1")
    if not keys or len(set(keys)) != len(keys) or not all(keys):
        out.append("split.keys must be distinct names")
    cutoffs = raw.get("cutoffs") or {}
    for name, arm in (raw.get("arms") or {}).items():
        if arm.get("cutoff") not in cutoffs:
            out.append(f"arm {name} names no declared cutoff")
        if not (arm.get("before") or arm.get("after")):
            out.append(f"arm {name} needs a date column")
    return out


def specs(raw: Mapping) -> dict[str, tuple[str, Spec]]:
    """(source, Spec) by task."""
    split, cutoffs = raw["split"], {k: str(v) for k, v in (raw.get("cutoffs") or {}).items()}
    listed = lambda x: [x] if isinstance(x, str) else list(x or [])
    arms = {n: Arm({c: cutoffs[a["cutoff"]] for c in listed(a.get("before"))}, {c: cutoffs[a["cutoff"]] for c in listed(a.get("after"))}) for n, a in (raw.get("arms") or {}).items()}
    test = split["test"]
    test = (float(test["fraction"]), test["key"]) if "fraction" in test else (test["column"], str(test["value"]))
    out = {}
    for name, t in raw["tasks"].items():
        rule = t["label_rule"]
        label = rule.get("function") or (fixtures.label_map(rule["column"], rule["map"]) if "map" in rule else rule["column"])
        out[name] = (t["source"], Spec(name, raw["id_column"], label, list(split["keys"]), test, float(_validation(split)), t["type"], raw.get("cluster_column"), t.get("cell_by"), arms))
    return out


def _called(df: DataFrame, folder: Path, task: Mapping, id_column: str) -> Column:
    """The label that a specification's own function (table -> column) gives, held to the columns that it declares."""
    from assayer.operators.project import load_module

    file, _, name = task["label_rule"]["function"].partition(":")
    refuse(FixtureError, [] if (folder / file).is_file() else [f"there is no file {folder / file} for the label rule"])
    rule = getattr(load_module(folder / file), name, None)
    refuse(FixtureError, [] if callable(rule) else [f"{file} has no function {name!r}"])
    return fixtures.checked_label(df, id_column, rule, task["label_columns"])


def metadata(rows: DataFrame, source: DataFrame, spec: Spec) -> dict:
    """Counts of a frozen task; all aggregates of a few rows."""
    counted = fixtures.exclusions(source, spec).first()
    found = fixtures.split_counts(rows, spec.keys).collect()
    splits = {r["cell"]: {} for r in found}
    for r in found:
        splits[r["cell"]][r["split_key"]] = {s: r[s] for s in fixtures.SPLITS}
    return {
        "rows_in": counted["rows_in"], "rows_kept": counted["rows_kept"], "excluded": counted["excluded"], "splits": splits, "cells": sorted(splits),
        "classes": {f"{r['split']}/{r['label']}": r["rows"] for r in fixtures.class_counts(rows, spec.keys[0]).collect()},
        "arms": {r["arm"]: r["rows"] for r in fixtures.arm_counts(rows).collect()} if spec.arms else {},
    }


def freeze(spark: SparkSession, path: str | Path, out: str | Path) -> Path:
    """Check and write a specification's fixture; returns its folder, named by the first 16 hex digits of its content."""
    path, out = Path(path).resolve(), Path(out).resolve()
    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    stated_at = path.parent / raw.get("construct", "construct.yaml")
    refuse(FixtureError, spec_problems(raw, construct.load(stated_at)))
    parts, tables = {}, {}
    for name, (source, spec) in specs(raw).items():
        at = path.parent / source
        df = read_source(spark, str(at), raw["id_column"])
        if "function" in raw["tasks"][name]["label_rule"]:
            spec = replace(spec, label=_called(df, path.parent, raw["tasks"][name], raw["id_column"]))
        fixtures.check(df, spec)
        rows = fixtures.assignments(df, spec)
        tables[name] = rows
        parts[name] = {"source": source, "source_sha256": file_digest(at), "content": content_digest(rows).first().asDict(), "meta": metadata(rows, df, spec)}
    body = {"spec": json.loads(json.dumps(raw, default=str)), "construct_sha256": file_digest(stated_at), "tasks": parts}
    digest = hashlib.sha256(canonical(body).encode()).hexdigest()
    folder = out / digest[:16]
    if (folder / "manifest.json").exists():
        load(spark, folder)
        return folder
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(str(folder / f"{name}.parquet"))
    write_atomic(folder / "manifest.json", json.dumps(body | {"digest": digest, "frozen_at": now(), "spec_path": str(path.resolve())}, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    return folder


def load(spark: SparkSession, folder: str | Path) -> tuple[dict, dict[str, DataFrame]]:
    """A frozen fixture's manifest and tables; refused if a table or a source was modified after it was frozen."""
    folder = Path(folder).resolve()
    if not (folder / "manifest.json").exists():
        raise FixtureError(f"there is no frozen fixture in {folder}")
    manifest = json.loads((folder / "manifest.json").read_text(encoding="utf-8"))
    tables, problems, base = {}, [], Path(manifest["spec_path"]).parent
    for name, part in manifest["tasks"].items():
        tables[name] = spark.read.parquet(str(folder / f"{name}.parquet"))
        if content_digest(tables[name]).first().asDict() != part["content"]:
            problems.append(f"the table of {name} is not what was frozen")
        source = base / part["source"]
        if not source.exists():
            problems.append(f"the source of {name} is gone")
        elif file_digest(source) != part["source_sha256"]:
            problems.append(f"the source of {name} is another one by now; freeze it again")
    refuse(StaleInput, problems)
    return manifest, tables


def report(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(task, cell, train, validation, test) under the primary key."""
    manifest, _ = load(spark, folder)
    key = manifest["spec"]["split"]["keys"][0]
    rows = [(t, c, *(by[key][s] for s in fixtures.SPLITS)) for t, p in manifest["tasks"].items() for c, by in p["meta"]["splits"].items()]
    return spark.createDataFrame(rows, "task string, cell string, train long, validation long, test long").orderBy("task", F.col("cell"))
