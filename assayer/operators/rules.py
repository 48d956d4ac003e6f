"""Decision rules over bootstrap intervals, and the null-input test that each must pass first."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.errors import RuleError, refuse
from assayer.functions.hashing import unit_hash
from assayer.functions.metrics import goodness
from assayer.operators.resample import difference_in_differences, paired_difference

EFFECT, NONE, OPEN = "effect", "no_effect", "inconclusive"
#: Draws of the null-input test and the share of them that may claim an effect.
DRAWS, RATE = 20, 0.15


def mismatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two methods' test predictions (id, label) that the other lacks or labels otherwise."""
    both = a.select("id", F.col("label").alias("_a")).join(b.select("id", F.col("label").alias("_b")), "id", "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b")))


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both methods' predictions (id, cell, cluster, label, score) side by side; refused unless they score the same rows."""
    if mismatched(a, b).limit(1).count():
        raise RuleError("the two methods were not scored on the same test rows")
    return a.withColumnRenamed("score", "score_a").join(b.select("id", F.col("score").alias("score_b")), "id")


def clears_floor(point: Column, lo: Column, hi: Column, floor: Column) -> Column:
    """effect: the interval excludes zero and the point exceeds the floor. no_effect: all of it lies within the floor."""
    effect = ((lo > 0) | (hi < 0)) & (F.abs(point) > floor)
    return F.when(effect, EFFECT).when((lo > -floor) & (hi < floor), NONE).otherwise(OPEN)


def difference_clears_floor(rows: DataFrame, floor: DataFrame, name: str, a: str = "score_a", b: str = "score_b", draws: int = 1000, seed: int = 0) -> DataFrame:
    """(cell, point, lo, hi, floor, outcome, better) of paired rows by cell against (cell, floor). A cell without a floor fails
    when its row is read: what the data can't resolve was not measured."""
    found = paired_difference(rows, ["cell"], name, a, b, draws, seed).join(F.broadcast(floor.select("cell", "floor")), "cell", "left")
    lacking = F.raise_error(F.concat(F.lit("no floor was measured for "), "cell")).cast("double")
    found = found.withColumn("floor", F.when(F.col("floor").isNull(), lacking).otherwise(F.col("floor")))
    sign = goodness(name, F.lit(1))
    outcome = clears_floor(F.col("point"), F.col("lo"), F.col("hi"), F.col("floor"))
    better = F.when(outcome == EFFECT, F.when(F.col("point") * sign > 0, a).otherwise(b))
    return found.select("cell", "point", "lo", "hi", "floor", outcome.alias("outcome"), better.alias("better"))


def k_of_n_cells(found: DataFrame, k: int, name: str = "roc_auc", by: Sequence[str] = ()) -> DataFrame:
    """A row (by..., cells, clears, unresolved, outcome) of (cell, point, lo, hi, floor): a cell clears if its interval is above
    zero and its point above the floor; it is unresolved unless its interval is below the floor."""
    flip = name in ("brier", "log_loss")
    point, lo, hi = (-F.col("point"), -F.col("hi"), -F.col("lo")) if flip else (F.col("point"), F.col("lo"), F.col("hi"))
    clear = F.coalesce((lo > 0) & (point > F.col("floor")), F.lit(False))
    unresolved = ~clear & ~F.coalesce(hi < F.col("floor"), F.lit(False))
    counted = found.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(clear).alias("clears"), F.count_if(unresolved).alias("unresolved"))
    outcome = F.when(F.col("clears") >= k, EFFECT).when(F.col("clears") + F.col("unresolved") >= k, OPEN).otherwise(NONE)
    return counted.withColumn("outcome", outcome)


def difference_of_drops(rows: DataFrame, name: str, seen: str, unseen: str, a: str = "score_a", b: str = "score_b", draws: int = 1000, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Whether a's lead over b differs between two arms, for each ``by``: effect or inconclusive, never no_effect."""
    found = difference_in_differences(rows, "arm", seen, unseen, name, a, b, draws, seed, by)
    return found.withColumn("outcome", F.when(F.col("excludes_zero"), EFFECT).otherwise(OPEN))


def mean_validation(scores: DataFrame, name: str) -> DataFrame:
    """(cell, method, value): mean of validation scores over all keys and seeds, more is better; nulls are skipped."""
    return scores.groupBy("cell", "method").agg(F.avg(goodness(name, F.col("score"))).alias("value"))


def best(values: DataFrame) -> DataFrame:
    """(cell, method, value) of the largest value, ties to the first by name; a cell without any value is refused by callers."""
    order = Window.partitionBy("cell").orderBy(F.desc_nulls_last("value"), "method")
    return values.where("value is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def null_pairs(spark: SparkSession, draws: int, rows: int = 240, seed: str = "null", same: bool = False, weak: float = 0.35) -> DataFrame:
    """Per draw (as ``cell``) rows of two methods that are equally good: scores that lean on the label alike, by counter hash, and by
    ``weak`` in the unseen arm. With ``same`` both scores are one and the same."""
    base = spark.range(draws * rows).select((F.col("id") / rows).cast("int").alias("draw"), F.col("id").cast("string").alias("id"))
    u = lambda what: unit_hash(f"{seed}/{what}", F.col("id"))
    label = (u("label") < 0.4).cast("int")
    arm = F.when(u("arm") < 0.5, "seen").otherwise("unseen")
    lean = F.when(arm == "unseen", F.lit(weak)).otherwise(F.lit(0.35))
    noisy = lambda m: lean * label + (1 - lean) * u(m)
    cell = F.concat(F.lit("draw-"), F.lpad(F.col("draw").cast("string"), 3, "0"))
    return base.select(cell.alias("cell"), "id", F.col("id").alias("cluster"), label.alias("label"), noisy("a").alias("score_a"), noisy("a" if same else "b").alias("score_b"), arm.alias("arm"))


@dataclass(frozen=True)
class Rule:
    name: str
    run: Callable[..., DataFrame]
    nulls: Callable[..., DataFrame]
    directional: bool
    ask: Callable[..., dict] | None = None

    @property
    def source_sha(self) -> str:
        return hashlib.sha256(inspect.getsource(self.run).encode()).hexdigest()


RULES: dict[str, Rule] = {}


def rule(name: str, nulls: Callable[..., DataFrame], directional: bool = False, ask: Callable[..., dict] | None = None) -> Callable:
    """Register a rule. ``ask(context, **params)`` answers a question of a project by it: (outcome, better, summary, details). ``nulls(spark, draws, run, same)`` gives (draw, outcome) of ``run``, the registered function itself, on inputs without
    an effect: two methods of equal skill, or with ``same`` one method twice."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        refuse(RuleError, [f"rule {name} is registered already"] if name in RULES else [])
        RULES[name] = Rule(name, f, nulls, directional, ask)
        return f

    return add


def _levels(rows: DataFrame, floor: float) -> DataFrame:
    return rows.select("cell").distinct().withColumn("floor", F.lit(floor))


def pair_nulls(spark: SparkSession, draws: int, run: Callable[..., DataFrame], same: bool = False) -> DataFrame:
    rows = null_pairs(spark, draws, same=same)
    return run(rows, _levels(rows, 0.04), "roc_auc", draws=200).select(F.col("cell").alias("draw"), "outcome")


def cell_nulls(spark: SparkSession, draws: int, run: Callable[..., DataFrame], same: bool = False, cells: int = 16, k: int = 5) -> DataFrame:
    rows = null_pairs(spark, draws * cells, 150, "null-cells", same)
    found = paired_difference(rows, ["cell"], "roc_auc", "score_a", "score_b", 100).withColumn("floor", F.lit(0.05))
    number = F.floor(F.regexp_extract("cell", "([0-9]+)$", 1).cast("int") / cells).cast("string")
    return run(found.withColumn("draw", number), k, by=["draw"]).select("draw", "outcome")


def drop_nulls(spark: SparkSession, draws: int, run: Callable[..., DataFrame], same: bool = False) -> DataFrame:
    """Both methods are worse on unseen rows, by as much: reading each one's drop by itself would see an effect."""
    rows = null_pairs(spark, draws, 600, "null-drops", same, weak=0.2).withColumnRenamed("cell", "draw")
    return run(rows, "roc_auc", "seen", "unseen", draws=200, by=["draw"]).select("draw", "outcome")


def ask_difference(context, cell: str, a: object, b: object, draws: int = 1000, seed: int = 0) -> dict:
    """Do methods a and b differ on a cell by more than its floor?"""
    one, two = context.method(cell, a), context.method(cell, b)
    r = difference_clears_floor(context.paired(cell, one, two), context.floor_frame([cell]), context.metric, draws=draws, seed=seed).first()
    better = {"score_a": one, "score_b": two}.get(r["better"])
    said = f"{one} - {two} = {r['point']:+.4f} [{r['lo']:+.4f}, {r['hi']:+.4f}] against a floor of {r['floor']:.4f}"
    return {"outcome": r["outcome"], "better": better, "summary": said, "details": r.asDict() | {"a": one, "b": two}}


def ask_cells(context, cells: Sequence[str], a: object, b: object, k: int, draws: int = 1000, seed: int = 0) -> dict:
    """Does a lead b beyond the floor in at least k of the cells?"""
    sides, rows = {}, None
    for cell in cells:
        sides[cell] = (context.method(cell, a), context.method(cell, b))
        own = context.paired(cell, *sides[cell])
        rows = own if rows is None else rows.unionByName(own)
    found = difference_clears_floor(rows, context.floor_frame(cells), context.metric, draws=draws, seed=seed)
    per = {r["cell"]: r.asDict() for r in found.collect()}
    again = rows.sparkSession.createDataFrame([(c, r["point"], r["lo"], r["hi"], r["floor"]) for c, r in per.items()], "cell string, point double, lo double, hi double, floor double")
    r = k_of_n_cells(again, k, context.metric).first()
    said = f"{r['clears']} of {r['cells']} cells clear their floor and {r['unresolved']} are unresolved; {k} are asked for"
    return {"outcome": r["outcome"], "better": None, "summary": said, "details": {"k": k, "cells": {c: per[c] | {"a": sides[c][0], "b": sides[c][1]} for c in per}}}


def ask_drops(context, cell: str, model: object, reference: object, seen_arm: str, unseen_arm: str, draws: int = 1000, seed: int = 0) -> dict:
    """Does the model lose more than the reference from the seen arm to the unseen one?"""
    one, two = context.method(cell, model), context.method(cell, reference)
    r = difference_of_drops(context.paired(cell, one, two), context.metric, seen_arm, unseen_arm, draws=draws, seed=seed).first()
    said = f"the lead of {one} over {two} changes by {r['point']:+.4f} [{r['lo']:+.4f}, {r['hi']:+.4f}] from {unseen_arm} to {seen_arm}"
    return {"outcome": r["outcome"], "better": None, "summary": said, "details": r.asDict() | {"a": one, "b": two}}


rule("difference_clears_floor", pair_nulls, directional=True, ask=ask_difference)(difference_clears_floor)
rule("k_of_n_cells", cell_nulls, ask=ask_cells)(k_of_n_cells)
rule("difference_of_drops", drop_nulls, ask=ask_drops)(difference_of_drops)


def allowed(draws: int, rate: float = RATE) -> int:
    return int(draws * rate)


def null_suite(spark: SparkSession, names: Sequence[str] | None = None, draws: int = DRAWS) -> DataFrame:
    """(rule, draws, effects, allowed, exact_claims, passed) of the rules on inputs without an effect; all draws of a rule are one plan.
    A rule passes if it claims an effect on at most ``allowed`` draws and on none where the two methods are one."""
    out = None
    for n in names or sorted(RULES):
        claimed = F.count_if(F.col("outcome") == EFFECT)
        exact = RULES[n].nulls(spark, 1, RULES[n].run, True).agg(claimed.alias("exact_claims"))
        one = RULES[n].nulls(spark, draws, RULES[n].run, False).agg(claimed.alias("effects")).crossJoin(F.broadcast(exact))
        one = one.select(F.lit(n).alias("rule"), F.lit(draws).cast("long").alias("draws"), "effects", F.lit(allowed(draws)).cast("long").alias("allowed"), "exact_claims")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", (F.col("effects") <= F.col("allowed")) & (F.col("exact_claims") == 0))


def gate(spark: SparkSession, names: Sequence[str], draws: int = DRAWS, known: dict | None = None) -> dict[str, dict]:
    """Results of the null-input test by rule, out of ``known`` where source and draws are current; refused if any fails."""
    refuse(RuleError, [f"the null-input test needs at least {DRAWS} draws"] if draws < DRAWS else [])
    refuse(RuleError, [f"unknown rule {n!r}" for n in names if n not in RULES])
    have = {n: r for n, r in (known or {}).items() if n in RULES and r.get("source_sha") == RULES[n].source_sha and r.get("draws") == draws}
    if todo := [n for n in dict.fromkeys(names) if n not in have]:
        have |= {r["rule"]: r.asDict() | {"source_sha": RULES[r["rule"]].source_sha} for r in null_suite(spark, todo, draws).collect()}
    refuse(RuleError, [f"{n}: {have[n]['effects']} of {draws} draws without an effect claim one, {have[n]['exact_claims']} of one method against itself; such rules fail the null-input test" for n in names if not have[n]["passed"]])
    return have
