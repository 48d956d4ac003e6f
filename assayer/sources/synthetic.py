"""Made-up trials with planted effects: what a benchmark of the engine should find, and what it should not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.hashing import unit_hash

#: How much a word of the summary moves the outcome, by phase: plainly in the first, hardly in the others.
EFFECTS = {"Phase1": 4.5, "Phase2": 0.3, "Phase3": 0.3}
WORDS = ("tablet", "weekly", "adults", "cohort", "open", "masked", "infusion", "daily", "arm")


def normal(u1: Column, u2: Column) -> Column:
    """A standard normal number out of two even ones (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * F.pi() * u2)


def trials(spark: SparkSession, per_phase: int = 600, seed: str = "trials-1", effects: dict[str, float] = EFFECTS) -> DataFrame:
    """``per_phase`` trials of each phase, every value a hash of the row's number: the same rows on any partitioning.

    Deaths follow age and sponsor a little everywhere, and the summary's "hepatic" as much as ``effects`` says."""
    u = lambda what: unit_hash(f"{seed}/{what}", F.col("trial_id"))
    base = spark.range(per_phase * len(effects)).select((F.col("id") / per_phase).cast("int").alias("p"), F.format_string("SYN%07d", "id").alias("trial_id"))
    phases = F.array(*(F.lit(p) for p in effects))
    strength = F.get(F.array(*(F.lit(float(e)) for e in effects.values())), F.col("p"))
    words = F.array_join(F.array(*(F.get(F.array(*map(F.lit, WORDS)), F.floor(u(f"word-{i}") * len(WORDS)).cast("int")) for i in range(6))), " ")
    hepatic = u("hepatic") < 0.3
    age = F.round(55 + 12 * normal(u("age-1"), u("age-2")), 1)
    sponsor = F.when(u("sponsor") < 0.6, "industry").when(u("sponsor") < 0.9, "academic").otherwise("government")
    rows = base.select(
        "trial_id", F.get(phases, F.col("p")).alias("phase"), age.alias("age"), (20 + F.floor(u("size") * 2980)).cast("int").alias("enrollment"), sponsor.alias("sponsor"),
        F.concat(words, F.when(hepatic, " hepatic impairment").otherwise(" renal function")).alias("summary"), strength.alias("s"), hepatic.alias("h"), u("death").alias("d"), (0.7 * normal(u("noise-1"), u("noise-2"))).alias("noise"),
        F.date_add(F.lit("2018-01-01"), F.floor(u("start") * 2550).cast("int")).alias("registered_on"), F.floor(300 + 1200 * u("lag")).cast("int").alias("lag"),
    )
    odds = -1.6 + 0.035 * (F.col("age") - 55) + 0.5 * (F.col("sponsor") == "academic").cast("int") + F.col("s") * F.col("h").cast("int") + F.col("noise")
    died = (F.col("d") < 1 / (1 + F.exp(-odds))).cast("int")
    return rows.select("trial_id", "phase", "age", "enrollment", "sponsor", "summary", died.alias("died"), F.col("registered_on").cast("string").alias("registered_on"), F.date_add("registered_on", F.col("lag")).cast("string").alias("results_posted_on"))
