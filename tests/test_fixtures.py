import pytest
from pyspark.sql import functions as F

from assayer.errors import FixtureError
from assayer.functions.hashing import unit_hash, unit_hash_of
from assayer.operators import fixtures
from assayer.operators.fixtures import Arm, Spec


def table(spark, n=400):
    return spark.range(n).select(
        F.format_string("T%04d", "id").alias("id"), (F.col("id") % 40).cast("string").alias("group"), F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("id") % 2 + 1).cast("int")).alias("phase"),
        (F.col("id") % 3 == 0).cast("int").alias("y"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("day"),
    )


def spec(**more):
    return Spec(**({"task": "t", "id": "id", "label": "y", "keys": ["k0", "k1"], "test": (0.2, "v1"), "validation": 0.25, "cell": "phase"} | more))


def test_hash_agrees_with_the_driver(spark):
    got = spark.range(200).select("id", unit_hash("key", F.col("id")).alias("u")).collect()
    assert all(r["u"] == unit_hash_of("key", r["id"]) for r in got)


def test_order_and_growth_move_no_row(spark):
    split = lambda df: {r["id"]: (r["split__k0"], r["split__k1"]) for r in fixtures.assignments(df, spec()).collect()}
    small, large = split(table(spark)), split(table(spark, 500).orderBy(F.desc("id")))
    assert all(large[k] == v for k, v in small.items())
    assert all((a == "test") == (b == "test") for a, b in large.values())
    assert any(a != b for a, b in large.values())


def test_shares_and_clusters(spark):
    rows = fixtures.assignments(table(spark, 4000).withColumn("group", (F.expr("cast(substring(id, 2) as int)") % 2000).cast("string")), spec(cluster="group", cell=None))
    n = rows.count()
    share = {r["split"]: r["rows"] / n for r in rows.groupBy(F.col("split__k0").alias("split")).agg(F.count("*").alias("rows")).collect()}
    assert 0.17 < share["test"] < 0.23 and 0.17 < share["validation"] < 0.23
    assert fixtures.cluster_splits(rows, "k0").where("splits > 1").count() == 0


def test_exclusions_are_counted_label_first(spark):
    df = table(spark).withColumn("y", F.when(F.col("id") >= "T0010", F.col("y"))).withColumn("phase", F.when(~F.col("id").isin("T0005", "T0020"), F.col("phase")))
    r = fixtures.exclusions(df, spec()).first()
    assert (r["rows_in"], r["rows_kept"]) == (400, 389)
    assert r["excluded"] == {fixtures.NO_LABEL: 10, "no value for phase": 1}


def test_arms(spark):
    df = spark.createDataFrame([("a", "2020-01-01"), ("b", None), ("c", "not a date"), ("d", "2022-01-01")], "id string, d string")
    got = {r["id"]: r["arm"] for r in df.select("id", fixtures.arm_column({"X": Arm(before={"d": "2022-01-01"})}).alias("arm")).collect()}
    assert got == {"a": "X", "b": None, "c": None, "d": None}
    both = {"old": Arm(before={"day": "2020-06-01"}), "new": Arm(after={"day": "2020-05-01"})}
    with pytest.raises(FixtureError, match="arms must be disjoint; old and new"):
        fixtures.check(table(spark), spec(arms=both))


def test_refusals_name_everything(spark):
    df = table(spark)
    twice = df.union(df.where("id = 'T0007'")).union(df.limit(1).withColumn("id", F.lit(None).cast("string")))
    with pytest.raises(FixtureError) as e:
        fixtures.check(twice, spec())
    assert any("T0007 appears more than once" in p for p in e.value.problems) and any("1 rows have no id" in p for p in e.value.problems)
    with pytest.raises(FixtureError, match="has one class only"):
        fixtures.check(df.withColumn("y", F.when(F.col("phase") == "A", 1).otherwise(F.col("y"))), spec())
    with pytest.raises(FixtureError, match="neither 0 nor 1"):
        fixtures.check(df.withColumn("y", F.col("y") + 1), spec())
    fixtures.check(df, spec())


def test_label_rules(spark):
    df = table(spark)
    assert df.select(fixtures.label_map("phase", {"A": 1}).alias("l")).where("l is null").count() == 200
    rule = lambda t: (F.col("y") + F.length("day") > 10).cast("int")
    assert df.select(fixtures.checked_label(df, "id", rule, ["y", "day"])).count() == 400
    with pytest.raises(FixtureError, match="does not name"):
        fixtures.checked_label(df, "id", rule, ["y"])


def test_source_join_refuses_lost_ids(spark):
    df = table(spark)
    rows = fixtures.assignments(df, spec())
    assert fixtures.with_source(rows, df.select(F.col("id").alias("key"), "day"), "key").count() == 400
    with pytest.raises(FixtureError, match="not in the source"):
        fixtures.with_source(rows, df.select(F.col("id").alias("key"), "day").where("key <> 'T0001'"), "key")


def test_empty_table(spark):
    assert fixtures.assignments(table(spark, 0), spec()).count() == 0
    assert fixtures.exclusions(table(spark, 0), spec()).first()["rows_in"] == 0
