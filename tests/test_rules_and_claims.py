import pytest
from pyspark.sql import functions as F

from assayer.errors import ClaimError, IncompleteGrid, LogError, RuleError, UnpricedModel
from assayer.operators import claims, costs, grid, logs, rules


def test_outcomes(spark):
    df = spark.createDataFrame([(0.1, 0.05, 0.2, 0.03), (0.01, -0.01, 0.02, 0.03), (0.1, -0.05, 0.2, 0.03), (None, None, None, 0.03), (0.02, 0.01, 0.03, 0.05)], "p double, lo double, hi double, f double")
    got = [r["o"] for r in df.select(rules.clears_floor(F.col("p"), F.col("lo"), F.col("hi"), F.col("f")).alias("o")).collect()]
    assert got == ["effect", "no_effect", "inconclusive", "inconclusive", "no_effect"]


def test_k_of_n(spark):
    df = lambda *r: spark.createDataFrame(r, "cell string, point double, lo double, hi double, floor double")
    win, noisy, same = ("a", 0.2, 0.1, 0.3, 0.05), ("b", 0.1, -0.1, 0.3, 0.05), ("c", 0.0, -0.01, 0.01, 0.05)
    out = lambda k, *r: rules.k_of_n_cells(df(*r), k).first()["outcome"]
    assert out(2, win, noisy) == "inconclusive" and out(1, win, noisy) == "effect" and out(1, same, same) == "no_effect"


def test_pairs_must_be_the_same_rows(spark):
    a = spark.createDataFrame([("1", "c", "1", 0, 0.1), ("2", "c", "2", 1, 0.9)], "id string, cell string, cluster string, label int, score double")
    assert rules.pair(a, a).count() == 2
    with pytest.raises(RuleError, match="were not|was not|not scored on the same"):
        rules.pair(a, a.where("id = '1'"))
    with pytest.raises(RuleError):
        rules.pair(a, a.withColumn("label", 1 - F.col("label")))


def test_best_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("c", "b", 0.9), ("c", "a", 0.9), ("c", "z", None)], "cell string, method string, value double")
    assert [r["method"] for r in rules.best(df).collect()] == ["a"]


def test_gate(spark):
    assert rules.allowed(3) == 0 and rules.allowed(20) == 3
    with pytest.raises(RuleError, match="at least 20 draws"):
        rules.gate(spark, ["difference_clears_floor"], 3)
    found = rules.gate(spark, ["difference_clears_floor"])
    assert found["difference_clears_floor"]["passed"]
    assert rules.gate(spark, ["difference_clears_floor"], known=found) == found

    def always(spark, draws, run, same):
        return spark.range(draws).select(F.col("id").cast("string").alias("draw"), F.lit("effect").alias("outcome"))

    rules.rule("always", always)(lambda rows: rows)
    try:
        with pytest.raises(RuleError, match="fail the null-input test"):
            rules.gate(spark, ["always"])
    finally:
        del rules.RULES["always"]


TRUTH = [("effect", "effect", "a", "confirmed"), ("effect", "no_effect", None, "refuted"), ("no_effect", "no_effect", None, "confirmed"), ("no_effect", "effect", "a", "refuted"), ("effect:a", "effect", "a", "confirmed"), ("effect:a", "effect", "b", "inverted"), ("effect:a", "inconclusive", None, "inconclusive")]


def test_status_truth_table(spark):
    df = spark.createDataFrame(TRUTH, "p string, o string, b string, want string")
    assert df.where(claims.status(F.col("p"), F.col("o"), F.col("b")) != F.col("want")).count() == 0
    assert all(claims.status_of(p, o, b) == want for p, o, b, want in TRUTH)
    with pytest.raises(ClaimError):
        claims.parse_prediction("no_effect:a")


def test_register_end_to_end(spark, tmp_path):
    r = claims.Register(tmp_path / "claims.jsonl")
    r.register("C1", "Q1", "effect:a", {"rule": "x"}, 1)
    r.register("C2", "Q2", "no_effect", {"rule": "y"}, 1)
    with pytest.raises(ClaimError, match="registered already"):
        r.register("C1", "Q1", "effect", {}, 1)
    with pytest.raises(ClaimError, match="later version"):
        r.amend("C1", "effect", {}, 1, "why")
    verdicts = {"Q1": {"outcome": "effect", "better": "a", "snapshot": {"rule": "x"}}}
    with pytest.raises(ClaimError, match="after the first run"):
        r.resolve(verdicts, "s", "2000-01-01")
    with pytest.raises(ClaimError, match="has changed since"):
        r.resolve({"Q1": verdicts["Q1"] | {"snapshot": {}}}, "s", "9999-01-01")
    with pytest.raises(ClaimError, match="oracle selection"):
        r.resolve({"Q1": verdicts["Q1"] | {"oracle": True}}, "s", "9999-01-01")
    assert [e["status"] for e in r.resolve(verdicts, "s", "9999-01-01")] == ["confirmed"]
    assert r.resolve(verdicts, "s", "9999-01-01") == []
    r.untested("C2", "no data")
    state = {x["claim"]: x["status"] for x in claims.replay(claims.log_frame(spark, r.path)).collect()}
    assert state == {"C1": "confirmed", "C2": "untested"}
    r.amend("C1", "effect", {"rule": "x"}, 2, "why")
    assert claims.replay(claims.log_frame(spark, r.path)).where("claim = 'C1'").first()["status"] == "registered"
    with pytest.raises(ClaimError, match="C1, which has no result"):
        r.check_document("as [claim:C1] says")
    assert r.check_document("[claim:C2]") == {"C2": "untested"}
    with pytest.raises(ClaimError, match="C9"):
        r.check_document("[claim:C9]")
    with pytest.raises(ClaimError, match="C2 is not cited"):
        r.check_document("[claim:C1]", require_all=True)
    late = claims.Register(tmp_path / "late.jsonl")
    late.register("E1", "Q1", "effect", {"rule": "x"}, 1, "found by looking", exploratory=True)
    assert [e["status"] for e in late.resolve(verdicts, "s", "2000-01-01")] == ["confirmed"] and late.state()["E1"]["exploratory"]


def test_log_refuses_edits(tmp_path):
    path = tmp_path / "log.jsonl"
    assert logs.read_log(path) == []
    logs.append(path, {"a": 1})
    logs.append(path, {"a": 2})
    with pytest.raises(LogError, match="set by the log"):
        logs.append(path, {"seq": 1})
    path.write_text(path.read_text().replace('"a":1', '"a":3'))
    with pytest.raises(LogError, match="breaks the hash chain"):
        logs.read_log(path)


def test_grid(spark):
    cells = grid.cells_frame(spark, [("t", f"t/{i}") for i in range(3)])
    planned = grid.plan(cells, ["a", "b"], ["k0", "k1"], [0, 1, 2])
    assert planned.count() == 36
    done = planned.where("method = 'a'").withColumn("status", F.lit("ok")).withColumn("code", F.lit("x"))
    assert grid.to_do(planned, done).count() == 18
    total = grid.coverage(grid.run_status(planned, done, "x")).where("method is null").first()
    assert (total["planned"], total["ok"], total["missing"], total["complete"]) == (36, 18, 18, False)
    assert grid.run_status(planned, done, "y").where("status = 'stale'").count() == 18
    with pytest.raises(IncompleteGrid, match="nothing is concluded"):
        grid.require_complete(grid.run_status(planned, done, "x"))


def test_costs(tmp_path):
    prices = costs.PriceTable.from_dict({"models": {"m": {"input_per_1k": 1.0, "output_per_1k": 2.0, "read_on": "2024-01-01", "source_url": "u"}}})
    meter = costs.Meter(prices)
    assert meter.record("m", 1000, 500) == 2.0 and meter.totals()["total"] == 2.0
    with pytest.raises(UnpricedModel, match="the call is not made"):
        meter.record("n", 1, 1)
    with pytest.raises(UnpricedModel, match="no price table was given"):
        costs.Meter(None).record("m", 1, 1)
    with pytest.raises(UnpricedModel, match="read_on is required"):
        costs.PriceTable.from_dict({"models": {"m": {"input_per_1k": -1, "output_per_1k": 2.0, "source_url": "u"}}})
    log = tmp_path / "r.jsonl"
    assert costs.record_repair(log, "fix", "why", {"a": 0.5, "b": 0.5}, {"a": 0.55, "b": 0.52})["mean_delta"] == pytest.approx(0.035)
    with pytest.raises(LogError, match="the same cells before and after"):
        costs.record_repair(log, "fix", "why", {"a": 1}, {"b": 1})
