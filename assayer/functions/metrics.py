"""Classification metrics as weighted aggregates over (label, score) or (label, probs), for any grouping.

Each takes rows with a weight column ``w``: an integer weight counts as so many copies of the row, which is what
lets a bootstrap draw be a join of multiplicities and not a copy of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smallest probability that log loss sees (the spacing of doubles at 1).
EPSILON = 2.0**-52
LOWER_IS_BETTER = ("brier", "log_loss")


def hard_label() -> Column:
    return (F.col("score") >= 0.5).cast("int")


def first_largest() -> Column:
    """The class with the largest probability, the first of several."""
    return (F.array_position("probs", F.array_max("probs")) - 1).cast("int")


def _keys(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by]


def _steps(rows: DataFrame, by: Sequence[str], ranges: int = 1) -> DataFrame:
    """Per group and distinct score: weights p and n of both classes, and tp, fp at or above the score. Tied scores are one
    step; rows meet in a map-side sum by score before the ordered pass over what is left.

    With ``ranges`` a group's scores are summed up range by range, each a task's, on top of what the ranges above it
    hold; without, a group is one task's."""
    grouped = rows.groupBy(*_keys(by), "score").agg(F.sum(F.col("w") * F.col("label")).cast("double").alias("p"), F.sum(F.col("w") * (1 - F.col("label"))).cast("double").alias("n"))
    if ranges > 1:
        grouped = grouped.withColumn("_range", F.floor(F.col("score") * ranges))
    inside = [*by, *(["_range"] if ranges > 1 else [])]
    above = Window.partitionBy(*_keys(inside)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = grouped.withColumn("tp", F.sum("p").over(above)).withColumn("fp", F.sum("n").over(above))
    if ranges == 1:
        return steps
    held = grouped.groupBy(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("_r")).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    higher = Window.partitionBy(*(F.col(f"_{c}") for c in by)).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns({"_tp": F.coalesce(F.sum("_p").over(higher), F.lit(0.0)), "_fp": F.coalesce(F.sum("_n").over(higher), F.lit(0.0))}).drop("_p", "_n")
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return steps.join(held, same).withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")})


def _both(value: Column) -> Column:
    """Null unless both classes have weight."""
    return F.when((F.sum("p") > 0) & (F.sum("n") > 0), value)


def ranked(rows: DataFrame, by: Sequence[str], ranges: int = 1) -> DataFrame:
    """(by..., pr_auc, roc_auc) in one pass; null where a group has one class."""
    hit = F.when(F.col("p") > 0, F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    pr = F.sum(hit) / F.sum("p")
    roc = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n"))
    return _steps(rows, by, ranges).groupBy(*_keys(by)).agg(_both(pr).alias("pr_auc"), _both(roc).alias("roc_auc"))


def one_vs_rest(rows: DataFrame, by: Sequence[str], ranges: int = 1) -> DataFrame:
    """Macro means of both over the classes; null if the group lacks a class."""
    each = rows.select(*by, "w", F.col("label").alias("_y"), F.posexplode("probs").alias("class", "score"))
    each = each.withColumn("label", (F.col("_y") == F.col("class")).cast("int"))
    per = ranked(each, [*by, "class"], ranges)
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c)
    return per.groupBy(*_keys(by)).agg(whole("pr_auc"), whole("roc_auc"))


def _confusion(rows: DataFrame, by: Sequence[str], predicted: Column) -> DataFrame:
    """(by..., class, tp, fp, fn) of the classes among labels and predictions."""
    pairs = rows.groupBy(*_keys(by), "label", predicted.alias("pred")).agg(F.sum("w").cast("double").alias("w"))
    sides = F.when(F.col("label") == F.col("pred"), F.array(F.struct(F.col("label").alias("class"), F.lit("tp").alias("side")))).otherwise(
        F.array(F.struct(F.col("label").alias("class"), F.lit("fn").alias("side")), F.struct(F.col("pred").alias("class"), F.lit("fp").alias("side")))
    )
    sums = [F.sum(F.when(F.col("s.side") == x, F.col("w")).otherwise(0.0)).alias(x) for x in ("tp", "fp", "fn")]
    return pairs.select(*by, "w", F.explode(sides).alias("s")).groupBy(*_keys(by), F.col("s.class").alias("class")).agg(*sums)


def _mean(value: Column) -> Column:
    return F.sum(value * F.col("w")) / F.sum("w")


def accuracy(rows: DataFrame, by: Sequence[str], predicted: Column) -> DataFrame:
    return rows.groupBy(*_keys(by)).agg(_mean((predicted == F.col("label")).cast("double")).alias("value"))


def balanced_accuracy(rows: DataFrame, by: Sequence[str], predicted: Column) -> DataFrame:
    """Mean recall of the classes that labels have."""
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    return _confusion(rows, by, predicted).groupBy(*_keys(by)).agg(F.avg(recall).alias("value"))


def _f1() -> Column:
    below = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(below > 0, 2 * F.col("tp") / below).otherwise(0.0)


def f1(rows: DataFrame, by: Sequence[str], predicted: Column) -> DataFrame:
    """Of class 1; zero where nothing is 1."""
    positive = F.max(F.when(F.col("class") == 1, _f1()))
    return _confusion(rows, by, predicted).groupBy(*_keys(by)).agg(F.coalesce(positive, F.lit(0.0)).alias("value"))


def macro_f1(rows: DataFrame, by: Sequence[str], predicted: Column) -> DataFrame:
    return _confusion(rows, by, predicted).groupBy(*_keys(by)).agg(F.avg(_f1()).alias("value"))


def brier(rows: DataFrame, by: Sequence[str], many: bool = False) -> DataFrame:
    one = F.pow(F.col("score") - F.col("label"), F.lit(2.0))
    if many:
        gaps = F.transform("probs", lambda p, k: F.pow(p - F.when(k == F.col("label"), 1.0).otherwise(0.0), F.lit(2.0)))
        one = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy(*_keys(by)).agg(_mean(one).alias("value"))


def log_loss(rows: DataFrame, by: Sequence[str], many: bool = False) -> DataFrame:
    own = F.get("probs", F.col("label")) if many else F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    clipped = F.greatest(F.least(own, F.lit(1 - EPSILON)), F.lit(EPSILON))
    return rows.groupBy(*_keys(by)).agg(_mean(-F.log(clipped)).alias("value"))


def tie_share(rows: DataFrame, by: Sequence[str], many: bool = False) -> DataFrame:
    """Share of rows whose score (largest probability) another row has too."""
    value = F.array_max("probs") if many else F.col("score")
    counted = rows.groupBy(*_keys(by), value.alias("_s")).agg(F.sum("w").alias("n"))
    return counted.groupBy(*_keys(by)).agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("value"))


def _pick(name: str, many: bool, ranges: int) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    def run(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return (one_vs_rest if many else ranked)(rows, by, ranges).select(*by, F.col(name).alias("value"))

    return run


def metric(name: str, many: bool = False, ranges: int = 1) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """The metric as (rows with label, score or probs, w; grouping columns) -> (grouping columns, value). ``ranges`` deals the
    ordered pass of a large group over so many tasks for each unit of the score."""
    predicted = first_largest() if many else hard_label()
    if name in ("pr_auc", "roc_auc"):
        return _pick(name, many, ranges)
    if name in ("brier", "log_loss", "tie_share"):
        return lambda rows, by: {"brier": brier, "log_loss": log_loss, "tie_share": tie_share}[name](rows, by, many)
    if name == "f1" and many:
        raise ValueError("f1 is for binary tasks; use macro_f1")
    if name in ("accuracy", "balanced_accuracy", "f1", "macro_f1"):
        return lambda rows, by: {"accuracy": accuracy, "balanced_accuracy": balanced_accuracy, "f1": f1, "macro_f1": macro_f1}[name](rows, by, predicted)
    raise ValueError(f"unknown metric {name!r}")


METRICS = ("pr_auc", "roc_auc", "accuracy", "balanced_accuracy", "f1", "macro_f1", "brier", "log_loss")


def goodness(name: str, value: Column) -> Column:
    """The value turned so that more is better."""
    return -value if name in LOWER_IS_BETTER else value


def guarded(rows: DataFrame, by: Sequence[str], name: str, many: bool = False) -> DataFrame:
    """(by..., score, tie_share), both null where a group's labels have one class; groups without rows don't appear."""
    classes = rows.groupBy(*_keys(by)).agg(F.count_distinct("label").alias("classes"))
    value = metric(name, many)(rows, by).withColumnRenamed("value", "score")
    ties = tie_share(rows, by, many).withColumnRenamed("value", "tie_share")
    both = lambda c: F.when(F.col("classes") > 1, F.col(c)).alias(c)
    return classes.join(value, list(by), "left").join(ties, list(by), "left").select(*by, both("score"), both("tie_share"))
