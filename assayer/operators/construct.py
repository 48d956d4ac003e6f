"""The construct: what is asked, which decision it serves, and by which number, stated before anything is frozen."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from pathlib import Path

import yaml

from assayer.errors import ConstructError, refuse
from assayer.functions.metrics import METRICS

REQUIRED = ("version", "stated_on", "owner", "question", "decision", "target", "metric", "tasks", "reported_numbers")
OPTIONAL = ("measures", "amendments")
#: The keys that each part must have.
PARTS = {"target": ("name", "definition"), "metric": ("name", "reason"), "tasks": ("name", "reason"), "reported_numbers": ("name", "decision"), "measures": ("quantity", "used", "instead_of", "reason"), "amendments": ("version", "date", "reason")}


#: Keys that a part may have besides.
MAY = {"metric": ("alternatives",)}


def _dated(value: object) -> bool:
    if isinstance(value, date):
        return True
    try:
        date.fromisoformat(str(value))
    except ValueError:
        return False
    return True


def _lacking(where: str, part: object, keys: tuple[str, ...]) -> list[str]:
    if not isinstance(part, Mapping):
        return [f"{where} must be a mapping"]
    found = [f"{where} needs {k}" for k in keys if part.get(k) in (None, "")]
    return found + [f"{where} has an unknown key {k!r}" for k in part if k not in (*keys, *MAY.get(where, ()))]


def problems(raw: object) -> list[str]:
    """Everything wrong with a construct statement."""
    if not isinstance(raw, Mapping):
        return ["the construct must be a mapping"]
    out = [f"the construct needs {k}" for k in REQUIRED if raw.get(k) in (None, "", [])]
    out += [f"unknown key {k!r}" for k in raw if k not in (*REQUIRED, *OPTIONAL)]
    version = raw.get("version")
    whole = isinstance(version, int) and not isinstance(version, bool) and version >= 1
    if version is not None and not whole:
        out.append("version must be a whole number from 1 on")
    if raw.get("stated_on") and not _dated(raw["stated_on"]):
        out.append("stated_on must be a date")
    for k in ("target", "metric"):
        if raw.get(k):
            out += _lacking(k, raw[k], PARTS[k])
    for k in ("tasks", "reported_numbers", "measures", "amendments"):
        items = raw.get(k) or []
        if not isinstance(items, list):
            out.append(f"{k} must be a list")
            continue
        for n, item in enumerate(items, 1):
            out += _lacking(f"{k} {n}", item, PARTS[k])
    metric = raw.get("metric")
    if isinstance(metric, Mapping) and metric.get("name") and metric["name"] not in METRICS:
        out.append(f"metric must be one of {', '.join(METRICS)}")
    if isinstance(metric, Mapping):
        others = metric.get("alternatives") or []
        out += ["the alternatives of metric must be a list"] if not isinstance(others, list) else [p for n, a in enumerate(others, 1) for p in _lacking(f"alternative {n}", a, ("name", "why_not"))]
    names = [t.get("name") for t in raw.get("tasks") or [] if isinstance(t, Mapping)]
    out += [f"task {n!r} appears more than once" for n in dict.fromkeys(names) if names.count(n) > 1]
    if whole:
        amended = [a for a in raw.get("amendments") or [] if isinstance(a, Mapping)]
        if [a.get("version") for a in amended] != list(range(2, version + 1)):
            out.append(f"version {version} needs one amendment for each version from 2 on, in order")
        out += [f"amendment {a.get('version')} needs a date" for a in amended if a.get("date") and not _dated(a["date"])]
    return out


def load(path: str | Path) -> dict:
    path = Path(path)
    if not path.exists():
        raise ConstructError(f"there is no construct at {path}; write down what is measured, and why, first")
    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    refuse(ConstructError, problems(raw))
    return raw
