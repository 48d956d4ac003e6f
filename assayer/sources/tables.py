"""Reading and writing tables; schemas that frozen artifacts are read with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGNMENTS = "id string, cluster string, cell string, label int"
PREDICTIONS = "task string, cell string, method string, split_key string, fit_seed int, id string, cluster string, split string, label int, score double, probs array<double>"
RUN_KEY = ("task", "cell", "method", "split_key", "fit_seed")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_source(spark: SparkSession, path: str, id_column: str | None = None, schema: str | None = None) -> DataFrame:
    """A source table by its suffix (csv, json, jsonl, parquet, orc); the id as text. Give csv a schema in production."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        out = reader.csv(path, header=True, inferSchema=schema is None)
    elif kind in ("json", "jsonl"):
        out = reader.json(path)
    elif kind == "orc":
        out = reader.orc(path)
    else:
        out = reader.parquet(path)
    return out.withColumn(id_column, F.col(id_column).cast("string")) if id_column else out


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """A table's columns from its header or footer: no row is read, no type inferred."""
    if path.rstrip("/").rsplit(".", 1)[-1].lower() == "csv":
        return spark.read.csv(path, header=True, inferSchema=False).columns
    return read_source(spark, path).columns


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from a headed CSV, one score a row in ``score`` or one for each class in p_0, p_1, ...: id, cluster, split, label, score and probs."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    classes = sorted((c for c in raw.columns if re.fullmatch("p_[0-9]+", c)), key=lambda c: int(c[2:]))
    if "score" not in raw.columns and not classes:
        raise ValueError(f"{path} has neither score nor p_0, p_1, ...")
    score = F.col("score").cast("double") if "score" in raw.columns else F.lit(None).cast("double")
    probs = F.array(*(F.col(c).cast("double") for c in classes)) if classes and "score" not in raw.columns else F.array(1 - score, score)
    return raw.select(*(F.col(c) for c in ("id", "cluster", "split")), F.col("label").cast("int").alias("label"), score.alias("score"), probs.alias("probs"))


def read_records(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON records anywhere under a folder, one file each, and (path) of the files that hold none."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    return files.where(~F.coalesce(broken, F.lit(True))).select("r.*").drop("_broken"), files.where(F.coalesce(broken, F.lit(True))).select("path")


def write_predictions(rows: DataFrame, path: str) -> None:
    """Overwrite the partitions of the runs in ``rows`` and no others, so that a rerun leaves nothing of an old run behind."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEY).parquet(path)


def write_text(rows: DataFrame, path: str) -> None:
    """Headed CSV with \\n endings, sorted by id."""
    rows.orderBy("id").write.mode("errorifexists").option("header", "true").option("lineSep", "\n").csv(path)


def content_digest(rows: DataFrame) -> DataFrame:
    """One row (rows, low, mixed): a digest that no order or partitioning of the rows changes, by partial aggregation alone."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    low, high = (F.conv(F.substring(row, s, 15), 16, 10).cast("decimal(38,0)") for s in (1, 16))
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(low), F.lit(0)).cast("string").alias("low"), F.coalesce(F.sum(high), F.lit(0)).cast("string").alias("mixed"))


def join_parts(features: DataFrame, targets: DataFrame, index: str) -> DataFrame:
    """Feature and target files of one part side by side; refused unless both have the same index."""
    lone = features.select(index).join(targets.select(F.col(index).alias("_t")), F.col(index) == F.col("_t"), "full").where(F.col(index).isNull() | F.col("_t").isNull()).limit(1).count()
    if lone:
        raise ValueError(f"features and targets have different {index}")
    return features.join(targets, index)
