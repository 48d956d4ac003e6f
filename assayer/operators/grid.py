"""The plan of runs, what is done of it, and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.errors import IncompleteGrid, refuse

KEY = ["task", "cell", "method", "split_key", "fit_seed"]
STATUSES = ("ok", "skipped", "error", "missing", "stale")
DONE = ("ok", "skipped")


def plan(cells: DataFrame, methods: Sequence[str], split_keys: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Every run key of cells (task, cell), in no order; the axes are explodes of literals, not joins."""
    out = cells.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).withColumn("split_key", F.explode(F.array(*map(F.lit, split_keys))))
    return out.withColumn("fit_seed", F.explode(F.array(*(F.lit(s) for s in seeds)))).select(*KEY)


def run_id() -> Column:
    return F.concat_ws("__", F.replace(F.col("cell"), F.lit("/"), F.lit("--")), "method", "split_key", F.concat(F.lit("s"), F.col("fit_seed").cast("string")))


def run_status(planned: DataFrame, runs: DataFrame, code: str | None = None) -> DataFrame:
    """The plan with each run's status: missing without a record, stale where the record was written under other code."""
    extra = [c for c in ("code",) if c in runs.columns]
    joined = planned.join(runs.select(*KEY, "status", *extra), KEY, "left")
    found = F.col("status")
    if code is not None and extra:
        found = F.when(F.col("status").isNotNull() & (F.col("code") != code), "stale").otherwise(found)
    return joined.select(*KEY, F.coalesce(found, F.lit("missing")).alias("status"))


def to_do(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs without an ok or skipped record."""
    return planned.join(runs.where(F.col("status").isin(*DONE)), KEY, "left_anti")


def coverage(statuses: DataFrame) -> DataFrame:
    """(method, planned, ok, skipped, error, missing, stale, complete) by method and, with a null method, in all: both from one
    grouping-sets pass, zero where a status doesn't occur."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    sets = statuses.groupingSets([[F.col("method")], []], "method").agg(F.count("*").alias("planned"), *counts)
    return sets.withColumn("complete", (F.col("error") + F.col("missing") + F.col("stale")) == 0)


def require_complete(statuses: DataFrame) -> None:
    open_ = statuses.where(~F.col("status").isin(*DONE))
    left = open_.count()
    some = [f"{r['cell']} {r['method']} {r['split_key']} s{r['fit_seed']} is {r['status']}" for r in open_.orderBy(*KEY).limit(5).collect()] if left else []
    refuse(IncompleteGrid, [f"the grid has {left} open runs, so nothing is concluded from it: " + "; ".join(some)] if left else [])


def mixed_code(records: DataFrame) -> DataFrame:
    """(code, records) where records were written under more than one code state."""
    counted = records.groupBy("code").agg(F.count("*").alias("records"))
    return counted.join(F.broadcast(counted.agg(F.count("*").alias("_states"))), F.col("_states") > 1).drop("_states")


def cells_frame(spark: SparkSession, cells: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(cells), "task string, cell string")
