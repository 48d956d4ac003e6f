"""Archives pinned by their digest, and tables that come in parts."""

from __future__ import annotations

import shutil
import tempfile
import urllib.request
import zipfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.errors import FixtureError, refuse
from assayer.operators.provenance import file_digest
from assayer.sources.tables import join_parts


def unpacked(source: str | Path, sha256: str, folder: str | Path) -> Path:
    """The folder of a zip archive (a path or an address) whose digest is ``sha256``, unpacked once: refused, with nothing
    written, if the digest differs or a member would land outside the folder."""
    folder = Path(folder)
    mark = folder / ".sha256"
    if mark.exists() and mark.read_text() == sha256:
        return folder
    with tempfile.TemporaryDirectory() as held:
        path = Path(source) if "://" not in str(source) else Path(held) / "archive.zip"
        if "://" in str(source):
            with urllib.request.urlopen(str(source)) as got, open(path, "wb") as out:
                shutil.copyfileobj(got, out, 1 << 20)
        refuse(FixtureError, [] if path.is_file() else [f"there is no archive {path}"])
        found = file_digest(path)
        refuse(FixtureError, [f"{source} is not the pinned archive: its sha256 is {found}"] if found != sha256 else [])
        with zipfile.ZipFile(path) as archive:
            outside = [n for n in archive.namelist() if not (folder / n).resolve().is_relative_to(folder.resolve())]
            refuse(FixtureError, [f"{source} has a member outside its folder: {n}" for n in outside])
            folder.mkdir(parents=True, exist_ok=True)
            archive.extractall(folder)
    mark.write_text(sha256)
    return folder


def stacked(spark: SparkSession, folder: str | Path, cells: Sequence[str], splits: Sequence[str], index: str, target: str, names: Mapping[str, str]) -> DataFrame:
    """One table of FOLDER/CELL/SPLIT_x.csv beside SPLIT_y.csv: ``index`` as text, the cell, the shipped split, the label out of
    ``target``, then the features. Refused where a part's x and y list different rows, or a row appears twice. ``names`` gives
    what the columns cell, split and label are called."""
    out = None
    for cell in cells:
        for split in splits:
            x, y = (spark.read.csv(str(Path(folder) / cell / f"{split}_{side}.csv"), header=True, inferSchema=True) for side in "xy")
            x, y = (df.withColumn(index, F.col(index).cast("string")) for df in (x, y))
            try:
                both = join_parts(x, y.select(index, F.col(target).cast("int").alias("_label")), index)
            except ValueError as e:
                raise FixtureError(f"{cell}, {split}: {e}") from e
            kept = [c for c in x.columns if c != index]
            part = both.select(index, F.lit(cell).alias(names["cell"]), F.lit(split).alias(names["split"]), F.col("_label").alias(names["label"]), *kept)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    twice = out.groupBy(index).count().where("count > 1").limit(1).collect()
    refuse(FixtureError, [f"{index} {r[index]} appears in more than one part" for r in twice])
    return out
