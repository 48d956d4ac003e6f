import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions.metrics import guarded, metric
from assayer.operators import resample, resolution


def rows(spark, y, s, w=None, **more):
    data = [("c", str(i), int(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(y, s, w if w is not None else [1] * len(y), strict=True))]
    return spark.createDataFrame(data, "cell string, cluster string, label int, score double, w int")


def value(spark, name, y, s, w=None):
    return metric(name)(rows(spark, y, s, w), ["cell"]).first()["value"]


def ap(y, s):
    total, hits = 0.0, 0
    for t in sorted(set(s), reverse=True):
        own = sum(a for a, b in zip(y, s, strict=True) if b == t)
        hits += own
        total += own * hits / sum(b >= t for b in s)
    return total / sum(y)


def auc(y, s):
    p, n = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])


def test_known_answers(spark):
    y, s = [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]
    assert value(spark, "roc_auc", y, s) == pytest.approx(0.75)
    assert value(spark, "pr_auc", y, s) == pytest.approx(0.8333, abs=1e-4)
    assert value(spark, "accuracy", y, s) == pytest.approx(0.75)
    assert value(spark, "brier", y, [0, 0, 1, 1]) == 0
    assert value(spark, "tie_share", y, [0.5, 0.5, 0.5, 0.9]) == 0.75 and value(spark, "tie_share", y, s) == 0
    assert value(spark, "log_loss", y, [0, 0, 1, 1]) == pytest.approx(0, abs=1e-12)
    assert value(spark, "roc_auc", [1, 1], [0.1, 0.2]) is None


def test_random_ties_and_weights_against_definitions(spark):
    rng = np.random.default_rng(0)
    data, want = [], {}
    for case in range(60):
        n = int(rng.integers(5, 40))
        y, s, w = rng.integers(0, 2, n), rng.integers(0, 6, n) / 5, rng.integers(1, 4, n)
        data += [(f"c{case}", int(a), float(b), int(c)) for a, b, c in zip(y, s, w, strict=True)]
        yy, ss = np.repeat(y, w).tolist(), np.repeat(s, w).tolist()
        want[f"c{case}"] = (ap(yy, ss), auc(yy, ss)) if 0 < sum(yy) < len(yy) else (None, None)
    df = spark.createDataFrame(data, "cell string, label int, score double, w int")
    for i, name in enumerate(("pr_auc", "roc_auc")):
        for r in metric(name)(df, ["cell"]).collect():
            exp = want[r["cell"]][i]
            assert r["value"] is None if exp is None else r["value"] == pytest.approx(exp, abs=1e-12)


def test_multiclass(spark):
    df = spark.createDataFrame([("c", 0, [0.7, 0.2, 0.1], 1), ("c", 1, [0.1, 0.8, 0.1], 1), ("c", 2, [0.4, 0.4, 0.2], 1)], "cell string, label int, probs array<double>, w int")
    get = lambda n: metric(n, many=True)(df, ["cell"]).first()["value"]
    assert get("accuracy") == pytest.approx(2 / 3)
    assert get("macro_f1") == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert get("brier") == pytest.approx((0.14 + 0.06 + 0.96) / 3)
    assert get("log_loss") == pytest.approx(-np.mean(np.log([0.7, 0.8, 0.2])))
    with pytest.raises(ValueError, match="macro_f1"):
        metric("f1", many=True)
    lacking = df.where("label < 2")
    assert metric("roc_auc", many=True)(lacking, ["cell"]).first()["value"] is None


def test_guarded_score_is_null_not_zero(spark):
    r = guarded(rows(spark, [1, 1], [0.2, 0.2]), ["cell"], "pr_auc").first()
    assert r["score"] is None and r["tie_share"] is None


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = 0.3 * y + 0.7 * rng.random(300)
    df = rows(spark, y, s).drop("w")
    one, two = (resample.bootstrap_metric(df, ["cell"], "roc_auc", 60).first() for _ in range(2))
    assert one == two and one["lo"] < one["point"] < one["hi"] and one["n_failed"] == 0
    wide = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    narrow = resample.bootstrap_metric(wide.withColumn("cluster", F.concat("cluster", F.col("copy").cast("string"))), ["cell"], "roc_auc", 60).first()
    assert resample.bootstrap_metric(wide, ["cell"], "roc_auc", 60).first()["half_width"] / narrow["half_width"] > 1.8
    few = resample.bootstrap_metric(rows(spark, [1] + [0] * 30, np.linspace(0, 1, 31)).drop("w"), ["cell"], "roc_auc", 60).first()
    assert few["n_failed"] > 0 and few["half_width"] is not None


def test_weights_draw_as_many_clusters_as_there_are(spark):
    df = spark.createDataFrame([("x", c) for c in "babca"], "cell string, cluster string")
    assert [(r["cluster"], r["slot"]) for r in resample.cluster_slots(df, ["cell"]).orderBy("slot").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    sums = resample.draw_weights(df, ["cell"], 20, 3).groupBy("draw").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 20 and all(r["w"] == 3 for r in sums)


def test_equal_scores_differ_by_nothing(spark):
    df = rows(spark, [0, 1, 0, 1, 1], [0.1, 0.9, 0.5, 0.4, 0.6]).drop("w").withColumn("b", F.col("score")).withColumnRenamed("score", "a")
    r = resample.paired_difference(df, ["cell"], "roc_auc", "a", "b", 30).first()
    assert r["point"] == r["lo"] == r["hi"] == 0 and not r["excludes_zero"]


def test_floor_is_the_largest_measured_term(spark):
    terms = spark.createDataFrame([("x", "m", 0.01, None, 0.02), ("x", "n", 0.03, None, 0.02), ("y", "m", None, None, None)], "cell string, method string, split_term double, fit_term double, test_term double")
    got = {r["cell"]: (r["floor"], r["source"], r["underpowered"]) for r in resolution.floors(terms).collect()}
    assert got == {"x": (0.02, "split", False), "y": (None, None, False)}
    one = spark.createDataFrame([("x", "m", "k", 0, 0.5)], "cell string, method string, split_key string, seed int, score double")
    assert resolution.split_terms(one).first()["split_term"] is None
