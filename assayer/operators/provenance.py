"""Code state and input digests on every artifact, checked when it is read."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from assayer.errors import StaleInput, refuse
from assayer.operators.logs import now

SKIPPED = {".git", "__pycache__", ".venv", "venv", "build", "dist", ".pytest_cache"}
CODE = ("*.py", "pyproject.toml", "requirements*.txt")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _files(root: Path, patterns: Sequence[str] = ("*",)) -> list[Path]:
    found = {p for g in patterns for p in root.rglob(g) if p.is_file() and not SKIPPED & set(p.relative_to(root).parts)}
    return sorted(found, key=lambda p: p.relative_to(root).as_posix())


def file_digest(path: str | Path) -> str:
    """sha256 of a file, or of the sorted paths and digests of a folder's files."""
    path, total = Path(path), hashlib.sha256()
    if path.is_dir():
        for p in _files(path):
            total.update(f"{p.relative_to(path).as_posix()}\0{file_digest(p)}\n".encode())
        return total.hexdigest()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            total.update(block)
    return total.hexdigest()


def code_state(root: str | Path) -> dict:
    """The digest of the source files as they are on disk, line ends made equal; git's commit beside it for reference."""
    root, total = Path(root), hashlib.sha256()
    for p in _files(root, CODE):
        total.update(f"{p.relative_to(root).as_posix()}\0{_sha(p.read_bytes().replace(b'\r\n', b'\n'))}\n".encode())
    ask = lambda *a: subprocess.run(["git", "-C", str(root), *a], capture_output=True, text=True).stdout.strip()
    try:
        commit, dirty = ask("rev-parse", "HEAD") or None, bool(ask("status", "--porcelain"))
    except OSError:
        commit, dirty = None, False
    return {"digest": total.hexdigest(), "commit": commit, "dirty": dirty}


def write_atomic(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def stamp(root: str | Path, inputs: Mapping[str, str | Path], at: str | Path) -> dict:
    base = Path(at).resolve().parent
    return {"written_at": now(), "code_state": code_state(root), "inputs": {k: {"path": os.path.relpath(Path(p).resolve(), base), "sha256": file_digest(p)} for k, p in inputs.items()}}


def write_artifact(path: str | Path, payload: Mapping, root: str | Path, inputs: Mapping[str, str | Path], overrides: Sequence[str] = ()) -> None:
    """A JSON artifact with what it was made from; ``overrides`` name the checks that were waived on the way."""
    mark = stamp(root, inputs, path) | ({"overrides": list(overrides)} if overrides else {})
    write_atomic(path, json.dumps({**payload, "_provenance": mark}, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def read_artifact(path: str | Path, root: str | Path | None = None, allow_code_drift: bool = False) -> dict:
    """An artifact, refused if an input is gone or changed, or if the code differs from what runs now."""
    path = Path(path)
    found = json.loads(path.read_text(encoding="utf-8"))
    mark = found.get("_provenance")
    if not mark:
        raise StaleInput(f"{path} has no provenance")
    problems = []
    for name, i in mark["inputs"].items():
        source = path.resolve().parent / i["path"]
        if not source.exists():
            problems.append(f"{path}: its input {name} is gone")
        elif file_digest(source) != i["sha256"]:
            problems.append(f"{path}: its input {name} is another one by now; make it anew")
    if root is not None and not allow_code_drift and mark["code_state"]["digest"] != code_state(root)["digest"]:
        problems.append(f"{path}: other code wrote it")
    refuse(StaleInput, problems)
    return found


def same_code(artifacts: Sequence[Mapping]) -> None:
    states = {a["_provenance"]["code_state"]["digest"] for a in artifacts}
    refuse(StaleInput, ["the artifacts come from more than one state of the code"] if len(states) > 1 else [])
