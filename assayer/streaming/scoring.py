"""The same splits and arms on a stream: they read one row at a time, so a stream gives what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.operators.fixtures import Spec, assignments, split_column


def assign_stream(source: DataFrame, spec: Spec) -> DataFrame:
    """Assignments of a streaming source; stateless."""
    return assignments(source, spec)


def split_counts_stream(source: DataFrame, spec: Spec, time: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, split, rows) under the primary key, rows later than ``late`` left out; state is a row a window and split."""
    rows = source.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    cluster = F.col(spec.cluster or spec.id).cast("string")
    split = split_column(cluster, spec.keys[0], spec.test, spec.validation)
    return rows.groupBy(F.window("_time", window).alias("window"), split.alias("split")).agg(F.count("*").alias("rows"))


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append assignments to a table, each batch exactly once by its checkpoint; what is there is processed and the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
