"""Large groups walk through their rows: the same draws as of small ones, and no row for each row and draw."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions import hashing
from assayer.operators import fixtures, resample, resolution, walks
from assayer.plans.catalogue import ORACLES, QUERIES
from tests.test_catalogue import FOLDER, flat

#: Queries of the catalogue over ranked metrics of large groups.
LARGE = ["bootstrap_interval", "difference_clears_floor", "k_of_n_cells", "paired_difference", "diff_in_diff", "difference_of_drops", "noise_test", "resolution_floor"]


@pytest.mark.parametrize("name", LARGE)
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_large_groups_give_the_rows_of_sql(spark, monkeypatch, name):
    monkeypatch.setattr(resample, "SMALL", 0)
    monkeypatch.setattr(resample, "draw_weights", lambda *_: pytest.fail("rows were joined to a table of draws"))
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(ORACLES[name])
    df = QUERIES[name](spark, FOLDER)
    assert flat(df.columns, [tuple(r) for r in df.collect()]) == flat([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", resample.RANKED)
@pytest.mark.parametrize("kinds", [1, 3, 1000])
def test_steps_run_on_over_chunks(monkeypatch, name, kinds):
    rng = np.random.default_rng(kinds)
    label, slot = rng.integers(0, 2, 200), rng.integers(0, 30, 200)
    score = rng.integers(0, kinds, 200) / kinds
    order = np.argsort(-score, kind="stable")
    monkeypatch.setattr(walks, "CHUNK", 1)
    columns = {"_g": np.zeros(200, int), "_slot": slot[order], "_label": label[order], "_score": score[order]}
    batches = pa.table(columns).to_batches(max_chunksize=7)
    counts = walks.Picked(range(5)).counts("0", 30, True)
    walk = walks.Walk(name, counts)
    for chunk in walks.packed(iter(batches), ["_g"]):
        for s, f in zip(chunk.column("_chunk").to_pylist(), chunk.column("_flags").to_pylist(), strict=True):
            walk.add(np.frombuffer(s, np.int32), np.frombuffer(f, np.uint8))
    assert np.allclose(walk.values(), resample._areas(label, score, counts[:, slot].astype(float), name))


def test_counts_are_those_of_the_relational_plan(spark):
    df = spark.createDataFrame([("x", f"{c:03}") for c in range(300)], "cell string, cluster string")
    want = np.zeros((4, 300), int)
    for r in resample.draw_weights(df, ["cell"], 4, 7).collect():
        want[r["draw"], int(r["cluster"])] = r["w"]
    picked = walks.Picked(range(4))
    picked.counts("7", 100, False)
    assert (picked.counts("7", 300, False) == want).all() and (picked.counts("7", 300, False).sum(axis=1) == 300).all()


@pytest.mark.parametrize("most", [2, walks.NARROW, 300])
@pytest.mark.parametrize("kinds", [1, 7, 400, 1 << 40])
def test_rows_are_summed_up_as_blocks(most, kinds):
    rng = np.random.default_rng(kinds % 1000 + most)
    label, slot, counts = rng.integers(0, 2, 1003), rng.integers(0, 30, 1003), rng.integers(0, most + 1, (5, 30))
    score = rng.integers(0, kinds, 1003) / kinds
    order = np.argsort(-score, kind="stable")
    start = np.concatenate([[True], np.diff(score[order]) != 0])
    lines = walks.by_slot(counts)
    assert lines.dtype == (np.uint16 if counts.max() <= walks.NARROW else np.int64)
    walk = walks.Walk("roc_auc", counts, lines)
    walk.add(slot[order].astype(np.int32), (label[order] * walks.LABEL + start * walks.START).astype(np.uint8))
    assert np.allclose(walk.values(), resample._areas(label, score, counts[:, slot].astype(float), "roc_auc"), rtol=1e-12)


def test_a_filter_on_the_test_set_makes_one_hash(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "x"))
    split = fixtures.split_column(F.col("id").cast("string"), "split-0", (0.2, "test-v1"), 0.25)
    plan = spark.read.parquet(str(tmp_path / "x")).withColumn("s", split).where("s = 'test'").select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "conv(" not in plan


def test_hashes_are_those_of_the_driver(spark):
    df = spark.range(2000).select("id", hashing.unit_hash("k", F.col("id")).alias("u"), *(hashing.below("k", F.col("id"), s).alias(f"b{i}") for i, s in enumerate((0.2, 0.0, 1.0))))
    for r in df.collect():
        u = hashing.unit_hash_of("k", r["id"])
        assert r["u"] == u and (r["b0"], r["b1"], r["b2"]) == (u < 0.2, False, u < 1.0)
    none = spark.range(1).select(hashing.below("k", F.lit(None), 0.2).alias("b")).first()
    assert none["b"] is None


def test_groups_are_counted_by_hash(spark):
    df = spark.createDataFrame([("x", "0"), ("x", "0"), ("y", "1"), (None, "1")], "cell string, _seed string")
    found = resample._groups(df, ["cell"])
    assert {(r["cell"], r["_seed"], r["n"]) for r in found.collect()} == {("x", "0", 2), ("y", "1", 1), (None, "1", 1)}
    assert "SortAggregate" not in df.groupBy("cell", "_seed").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()


def test_one_long_sorts_by_group_then_by_falling_score(spark):
    scores = [0.0, -0.0, 1.0, 0.5, 0.5 + 2.0**-40, 7.25, -3.5, 1e300, -1e300, 1 - 2.0**-53]
    df = spark.createDataFrame([(g, s) for g in (1, 2, 2**32 - 1) for s in scores], "g long, _score double")
    got = [(r["g"], -r["_score"]) for r in df.repartition(1).sortWithinPartitions(resample._falling(F.col("g")), F.desc("_score")).collect()]
    assert got == sorted(got)


def test_scores_are_computed_once_for_both_terms(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("c", "m", k, s, float(i)) for i, (k, s) in enumerate((k, s) for k in ("a", "b") for s in (0, 1))]
    scores = spark.createDataFrame(rows, "cell string, method string, split_key string, seed int, score double")
    tests = scores.select("cell", "method", "split_key", "seed", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("x"))
    tests = tests.select("*", F.col("x").cast("string").alias("cluster"), (F.col("x") % 2).cast("int").alias("label"), (F.col("x") / 10).alias("score")).drop("x")
    assert resolution.resolve(scores.mapInArrow(count, scores.schema), tests, "roc_auc", 5).count() == 1 and seen.value == len(rows)


@pytest.mark.parametrize("kinds", [1, 5, 1 << 40])
def test_areas_of_ranges_add_up(spark, kinds):
    rng = np.random.default_rng(kinds % 1000)
    label, score = rng.integers(0, 2, 3000), rng.integers(0, kinds, 3000) / kinds
    cells = [None, "x", "y"] * 1000
    rows = [(c, int(y), float(s)) for c, y, s in zip(cells, label, score, strict=True)] + [("one class", 1, 0.5)]
    got = {r["cell"]: r["value"] for r in resample.roc_auc(spark.createDataFrame(rows, "cell string, label int, score double"), ["cell"]).collect()}
    assert got.pop("one class") is None and len(got) == 3
    for i, c in enumerate([None, "x", "y"]):
        assert abs(got[c] - resample._areas(label[i::3], score[i::3], np.ones((1, 1000)), "roc_auc")[0]) < 1e-12
