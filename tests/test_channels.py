import pytest
from pyspark.sql import functions as F

from assayer.errors import ChannelError
from assayer.operators import methods
from assayer.operators.channels import INFREQUENT, Channel, Featurizer, Registry
from assayer.operators.runner import Grid, run_grid


def values(df):
    return {(r["id"], r["feature"]): round(r["value"], 9) for r in df.collect()}


def rows(spark):
    data = [("1", "train", 1.0, "a", "x y;z", "red apples", 1), ("2", "train", None, "a", "x", "red pears", 0), ("3", "train", 3.0, "b", None, "green pears", 1), ("4", "test", 5.0, "c", "z;q", "red plums", 0), ("5", "test", None, None, "", None, 0)]
    return spark.createDataFrame(data, "id string, split string, n double, c string, m string, t string, label int")


def fitted(spark, channel):
    df = rows(spark)
    return values(Featurizer([channel], "split").fit(df.where("split = 'train'")).transform(df.where("split = 'test'")))


def test_numeric(spark):
    assert fitted(spark, Channel("n", "numeric", ["n"])) == {("4", "n:n"): 5.0, ("5", "n:n"): 2.0}
    got = fitted(spark, Channel("n", "numeric", ["n"], {"scale": True, "missing_indicator": True, "impute": "zero"}))
    assert got[("4", "n:n")] == pytest.approx((5 - 4 / 3) / (14 / 9) ** 0.5) and got[("5", "n:missing(n)")] == pytest.approx((1 - 1 / 3) / (2 / 9) ** 0.5)


def test_one_hot(spark):
    assert fitted(spark, Channel("c", "categorical", ["c"], {"encoding": "one_hot"})) == {}
    got = fitted(spark, Channel("c", "categorical", ["c"], {"encoding": "one_hot", "min_frequency": 2}))
    assert got == {("4", f"c:c={INFREQUENT}"): 1.0, ("5", f"c:c={INFREQUENT}"): 1.0}


def test_multihot_and_text(spark):
    assert fitted(spark, Channel("m", "multihot", ["m"])) == {("4", "m:m=z"): 1.0}
    got = fitted(spark, Channel("t", "text", ["t", "c"]))
    assert got == {("4", "t:red"): 1.0}
    assert ("4", "t:red") in fitted(spark, Channel("t", "text", ["t"], {"ngram_max": 2}))


def test_target_encoding_does_not_leak(spark):
    from assayer.functions.hashing import unit_hash
    from assayer.functions.metrics import metric

    df = spark.range(1200).select(F.col("id").cast("string").alias("id"), F.lit("train").alias("split"), F.concat(F.lit("v"), "id").alias("c"), (unit_hash("y", F.col("id")) < 0.5).cast("int").alias("label"))
    enc = Featurizer([Channel("c", "categorical", ["c"], {"encoding": "target"})], "split").fit(df).transform(df, training=True)
    scored = enc.join(df, "id").select(F.lit("x").alias("cell"), "label", F.col("value").alias("score"), F.lit(1).alias("w"))
    assert metric("roc_auc")(scored, ["cell"]).first()["value"] < 0.6


def test_guards(spark):
    with pytest.raises(ChannelError, match="not from 2 test rows"):
        Featurizer([], "split").fit(rows(spark))
    with pytest.raises(ChannelError, match="must be fitted before"):
        Featurizer([], "split").transform(rows(spark))
    reg = Registry([Channel("a", "numeric", ["n", "label", "gone"]), Channel("b", "categorical", ["c", "n"], {})], {"t": ""})
    found = " | ".join(reg.problems())
    assert "encoding must be given" in found and "is in channels a and b" in found and "has no reason" in found
    with pytest.raises(ChannelError) as e:
        reg.check(["id", "n", "c", "m", "t", "label"], ["label"], ["id"])
    text = " | ".join(e.value.problems)
    assert "'m' is not registered to any channel" in text and "which the table lacks" in text and "would leak" in text
    with pytest.raises(ChannelError, match="unknown channel"):
        reg.pick("t", ["zzz"])


def test_grid_run(spark, tmp_path):
    from assayer.functions.hashing import unit_hash

    u = lambda k: unit_hash(k, F.col("id"))
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("cluster"), F.lit("t").alias("cell"), u("x").alias("x"), (u("x") + 0.5 * u("e") > 0.75).cast("int").alias("label"), F.when(u("s") < 0.6, "train").when(u("s") < 0.8, "validation").otherwise("test").alias("split__k"))

    class Broken(methods.Method):
        def fit_predict(self, *a):
            raise ValueError("broken")

    class Away(methods.Method):
        def unavailable(self):
            return "not here"

    methods.REGISTRY |= {"broken": Broken, "away": Away}
    try:
        grid = Grid("t", ["t"], ["majority", "logreg", "broken", "away"], ["k"], [0], Registry([Channel("n", "numeric", ["x"], {"scale": True})]), "roc_auc")
        out = run_grid(spark, df, grid, None, str(tmp_path / "p"), "code")
        got = {r["method"]: r for r in out.collect()}
    finally:
        del methods.REGISTRY["broken"], methods.REGISTRY["away"]
    assert got["logreg"]["score_test"] > 0.8 and got["majority"]["score_test"] == pytest.approx(0.5)
    assert got["broken"]["status"] == "error" and "broken" in got["broken"]["reason"] and (got["away"]["status"], got["away"]["reason"]) == ("skipped", "not here")
    found = spark.read.parquet(str(tmp_path / "p"))
    assert found.where("method = 'logreg'").count() == df.where("split__k <> 'train'").count() and "train" not in {r[0] for r in found.select("split").distinct().collect()}


def test_target_encoding_of_many_classes(spark):
    rows = [(str(i), ["a", "b"][i % 2], [0, 1, 2, 2][i % 4], "train" if i < 40 else "test") for i in range(48)]
    df = spark.createDataFrame(rows, "id string, c string, label int, split string")
    channel = Channel("x", "categorical", ["c"], {"encoding": "target"})
    fitted = Featurizer([channel], "split", 3).fit(df.where("split = 'train'"))
    got = {(r["id"], r["feature"]): r["value"] for r in fitted.transform(df.where("split = 'test'")).collect()}
    assert {f for _, f in got} == {"x:c[0]", "x:c[1]", "x:c[2]"}
    # category a: labels 0 and 2 evenly; category b: 1 and 2; shrunk by one row to the overall shares
    assert got[("40", "x:c[0]")] == pytest.approx((10 + 0.25) / 21) and got[("40", "x:c[1]")] == pytest.approx(0.25 / 21) and got[("41", "x:c[2]")] == pytest.approx((10 + 0.5) / 21)
    assert sum(fitted.transform(df.where("split = 'train'"), training=True).where("id = '0'").toPandas()["value"]) == pytest.approx(1.0)
