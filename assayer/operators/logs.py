"""Hash-chained append-only logs: one writer on the driver, checked as a DataFrame at any length."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.errors import LogError, refuse

START = "0" * 64
RESERVED = ("seq", "recorded_at", "prev", "hash")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(entry: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in entry.items() if k != "hash"}).encode()).hexdigest()


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


def read_log(path: str | Path) -> list[dict]:
    """The entries of a log; a missing file is an empty one. Refused where an entry breaks the hash chain."""
    path, out, prev = Path(path), [], START
    if not path.exists():
        return out
    for n, line in enumerate(path.read_text(encoding="utf-8").splitlines(), 1):
        try:
            entry = json.loads(line)
        except ValueError as e:
            raise LogError(f"{path}: line {n} is not JSON") from e
        if entry.get("prev") != prev or entry.get("seq") != n or entry.get("hash") != digest(entry):
            raise LogError(f"{path}: line {n} breaks the hash chain")
        prev = entry["hash"]
        out.append(entry)
    return out


def append(path: str | Path, entry: dict) -> dict:
    """Add an entry and flush it to disk; the whole chain is checked first."""
    refuse(LogError, [f"{k!r} is set by the log" for k in RESERVED if k in entry])
    known = read_log(path)
    full = entry | {"seq": len(known) + 1, "recorded_at": now(), "prev": known[-1]["hash"] if known else START}
    full["hash"] = digest(full)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8", newline="\n") as f:
        f.write(canonical(full) + "\n")
        f.flush()
        os.fsync(f.fileno())
    return full


def broken_entries(lines: DataFrame) -> DataFrame:
    """Rows of raw lines (log, line) of any number of logs that break a chain: an entry whose own hash is not that of its body, or
    whose ``prev`` or ``seq`` doesn't follow. The body is the line's canonical text without its hash."""
    entry = F.from_json("line", "seq long, prev string, hash string")
    told = F.regexp_replace("line", r',?"hash":"[0-9a-f]{64}"', "")
    own = lines.select("log", "line", entry.alias("e"), F.sha2(F.regexp_replace(told, r"^\{,", "{"), 256).alias("found")).select("log", "line", "e.*", "found")
    broken = broken_links(own.select("log", "seq", "prev", "hash")).select("log", "seq").distinct()
    edited = own.where(F.col("hash").isNull() | (F.col("hash") != F.col("found"))).select("log", "seq")
    return broken.union(edited).distinct()


def broken_links(entries: DataFrame) -> DataFrame:
    """Rows of (log, seq, prev, hash) whose ``prev`` isn't the hash before, or whose ``seq`` doesn't follow."""
    own = Window.partitionBy("log").orderBy("seq")
    linked = entries.withColumn("_prev", F.lag("hash", 1, START).over(own)).withColumn("_seq", F.row_number().over(own))
    return linked.where((F.col("prev") != F.col("_prev")) | (F.col("seq") != F.col("_seq"))).drop("_prev", "_seq")
