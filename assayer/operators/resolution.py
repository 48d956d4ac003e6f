"""What the data can resolve: noise by source (split, fit, test set), and the floor of each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.resample import bootstrap_metric
from assayer.sources.shared import stored

TERMS = ("split", "fit", "test")
WIDTH = 1.96
THRESHOLD = 0.05


def spread(value: str) -> Column:
    """95 % half-width of a sample; null of fewer than two values: not measured is not zero."""
    return WIDTH * F.stddev_samp(F.when(~F.isnan(value), F.col(value)))


def split_terms(scores: DataFrame) -> DataFrame:
    """(cell, method, split_term) of (cell, method, split_key, seed, score): spread over keys, averaged over seeds."""
    per = scores.groupBy("cell", "method", "seed").agg(spread("score").alias("s"))
    return per.groupBy("cell", "method").agg(F.avg("s").alias("split_term"))


def fit_terms(scores: DataFrame) -> DataFrame:
    """(cell, method, fit_term): spread over seeds, averaged over keys."""
    per = scores.groupBy("cell", "method", "split_key").agg(spread("score").alias("s"))
    return per.groupBy("cell", "method").agg(F.avg("s").alias("fit_term"))


def test_terms(predictions: DataFrame, name: str, draws: int, seed: int = 0, many: bool = False) -> DataFrame:
    """(cell, method, test_term) of test predictions (cell, method, split_key, seed, cluster, label, score): half-width of the
    cluster bootstrap, averaged over runs."""
    by = ["cell", "method", "split_key", "seed"]
    return bootstrap_metric(predictions, by, name, draws, seed, many).groupBy("cell", "method").agg(F.avg("half_width").alias("test_term"))


def floors(terms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cell, split_term, fit_term, test_term, floor, source, underpowered) of (cell, method, *_term).

    Each term is the median over methods that measured it; the floor is the largest, from the first of split, fit, test that
    has it; null where nothing was measured.
    """
    mid = terms.groupBy("cell").agg(*(F.median(f"{t}_term").alias(f"{t}_term") for t in TERMS))
    mid = mid.withColumn("floor", F.greatest(*(f"{t}_term" for t in TERMS)))
    source = F.coalesce(*(F.when(F.col(f"{t}_term") == F.col("floor"), t) for t in TERMS))
    return mid.withColumn("source", source).withColumn("underpowered", F.coalesce(F.col("floor") > threshold, F.lit(False)))


def test_sizes(predictions: DataFrame) -> DataFrame:
    """(cell, n_test, n_clusters) of the primary run's test rows."""
    return predictions.groupBy("cell").agg(F.count("*").alias("n_test"), F.count_distinct("cluster").alias("n_clusters"))


def resolve(scores: DataFrame, predictions: DataFrame, name: str, draws: int = 1000, threshold: float = THRESHOLD) -> DataFrame:
    """The resolution table of a complete grid's scores and test predictions."""
    on = ["cell", "method"]
    scores = stored(scores, "scores")  # both terms read it
    terms = split_terms(scores).join(fit_terms(scores), on, "full").join(test_terms(predictions, name, draws), on, "full")
    return floors(terms, threshold)
