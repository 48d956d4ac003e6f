"""Runs of the grid: featurise, fit, predict, score; resumable, every planned run leaves a record or a reason."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.errors import IncompleteGrid, refuse
from assayer.functions.metrics import guarded
from assayer.operators import methods
from assayer.operators.channels import Channel, Featurizer, Registry
from assayer.operators.grid import DONE, KEY, cells_frame, plan, run_status, to_do
from assayer.operators.methods import vectors
from assayer.operators.resample import weighted_once
from assayer.sources.tables import RUN_KEY, write_predictions

RECORD = "task string, cell string, method string, split_key string, fit_seed int, status string, reason string, code string, metric string, score_validation double, score_test double, n_train long, n_eval long, n_features int"


def vectorised(chosen: Sequence[Channel], split: str, train: DataFrame, rest: DataFrame, classes: int = 2) -> tuple[DataFrame, DataFrame, int]:
    """Training rows and others with a ``features`` vector, and how many features there are. The vocabulary is numbered where
    it is and joined by name; its size alone reaches the driver."""
    fitted = Featurizer(chosen, split, classes).fit(train)
    own = fitted.transform(train, training=True).persist()
    index = own.select("feature").distinct().withColumn("at", F.row_number().over(Window.orderBy("feature")) - 1).persist()
    n = index.count()
    return vectors(own, index, n, train), vectors(fitted.transform(rest), index, n, rest), n


class Features:
    """Feature frames by cell, split key and channels, made once for all methods and seeds that read the same."""

    def __init__(self, rows: DataFrame, classes: int) -> None:
        self.rows, self.classes, self.made, self.locks, self.lock = rows, classes, {}, {}, Lock()

    def of(self, cell: str, split_key: str, chosen: Sequence[Channel]) -> tuple:
        key = (cell, split_key, tuple(c.name for c in chosen))
        with self.lock:
            own = self.locks.setdefault(key, Lock())
        with own:
            if key not in self.made:
                mine = self.rows.where(F.col("cell") == cell).withColumn("split", F.col(f"split__{split_key}"))
                train, rest, n = vectorised(chosen, "split", mine.where("split = 'train'"), mine.where("split <> 'train'"), self.classes)
                train, rest = train.select("id", "label", "features").persist(), rest.select("id", "cluster", "split", "label", "features").persist()
                self.made[key] = (train, rest, n, train.count(), rest.count())
        return self.made[key]


@dataclass(frozen=True)
class Grid:
    task: str
    cells: Sequence[str]
    methods: Sequence[str]
    split_keys: Sequence[str]
    seeds: Sequence[int]
    registry: Registry
    metric: str
    classes: int = 2


def run_one(features: Features, grid: Grid, key: dict, code: str) -> tuple[dict, DataFrame | None]:
    """The record and predictions of one run over assignments joined to their source. Failures become records."""
    record = dict(key) | {"status": "ok", "reason": None, "code": code, "metric": grid.metric, "score_validation": None, "score_test": None, "n_train": None, "n_eval": None, "n_features": None}
    try:
        method = methods.make(key["method"])
        if reason := method.unavailable():
            return record | {"status": "skipped", "reason": reason}, None
        chosen = [c for c in grid.registry.channels if c.serves(grid.task) and (method.kinds is None or c.kind in method.kinds)]
        if not chosen:
            return record | {"status": "skipped", "reason": f"no channel of a kind that {key['method']} reads"}, None
        train, rest, n, n_train, n_eval = features.of(key["cell"], key["split_key"], chosen)
        probs = method.fit_predict(train, rest, grid.classes, key["fit_seed"])
        many = grid.classes > 2
        found = rest.drop("features").join(probs, "id").withColumn("score", F.when(F.lit(not many), F.get("probs", F.lit(1)))).persist()
        scores = {r["split"]: r["score"] for r in guarded(weighted_once(found), ["split"], grid.metric, many).collect()}
        record |= {"score_validation": scores.get("validation"), "score_test": scores.get("test"), "n_train": n_train, "n_eval": n_eval, "n_features": n}
        return record, found.select(*(F.lit(key[k]).alias(k) for k in RUN_KEY), "id", "cluster", "split", "label", "score", "probs")
    except Exception:
        return record | {"status": "error", "reason": traceback.format_exc(limit=3)[-2000:]}, None


def run_grid(spark: SparkSession, rows: DataFrame, grid: Grid, records: DataFrame | None, predictions: str, code: str, rerun_stale: bool = False, keep: Callable[[dict], None] | None = None, threads: int = 4) -> DataFrame:
    """Records of the whole plan after running what is open: missing and failed runs; stale ones are refused or rerun.

    ``rows`` has the assignments with their source columns. Each run's predictions replace that run's partition under
    ``predictions``, and ``keep`` gets its record once they are written: what it stores need not be run again after an
    interruption. ``threads`` runs share the cluster at a time.
    """
    cells = cells_frame(spark, [(grid.task, c) for c in grid.cells])
    planned = plan(cells, grid.methods, grid.split_keys, grid.seeds)
    records = spark.createDataFrame([], RECORD) if records is None else records
    stale = run_status(planned, records, code).where("status = 'stale'").limit(5).collect()
    refuse(IncompleteGrid, [f"runs are stale: {', '.join('/'.join(str(r[k]) for k in KEY) for r in stale)}; rerun them"] if stale and not rerun_stale else [])
    names = [f.split()[0] for f in RECORD.split(", ")]
    current = records.where((F.col("code") == code) & F.col("status").isin(*DONE))
    done = [tuple(r) for r in current.select(*names).collect()]
    features, kept = Features(rows.persist(), grid.classes), Lock()

    def one(key: dict) -> tuple:
        record, found = run_one(features, grid, key, code)
        if found is not None:
            try:
                write_predictions(found, predictions)
            except Exception:
                record |= {"status": "error", "reason": traceback.format_exc(limit=3)[-2000:]}
        with kept:
            if keep:
                keep(record)
        return tuple(record[n] for n in names)

    todo = [r.asDict() for r in to_do(planned, current).orderBy(*KEY).collect()]
    try:
        with ThreadPoolExecutor(max(1, threads)) as pool:
            done += pool.map(one, todo)
    finally:
        spark.catalog.clearCache()
    return spark.createDataFrame(done, RECORD)
