"""A whole project from files to checked claims, broken off once on the way."""

import json

import pytest

from assayer import cli
from assayer.errors import FixtureError, RuleError, RunError
from assayer.operators import project, rules, runner
from assayer.operators.claims import Register
from assayer.operators.logs import read_log
from assayer.plans import example


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("project")
    example.write(spark, out, 600)
    return out


def test_example_from_files_to_claims(spark, folder, monkeypatch, capsys):
    grid = (folder / "grid.yaml").read_text()
    (folder / "grid.yaml").write_text(grid.replace("hist_gbm, ", "").replace("threads: 8", "threads: 2").replace("[0, 1]", "[0]"))
    questions = (folder / "questions.yaml").read_text()
    (folder / "questions.yaml").write_text(questions.replace("[logreg, hist_gbm]", "[logreg, majority]"))
    with pytest.raises(SystemExit):
        example.steps(folder, [["run"]])
    example.steps(folder, example.before_runs())
    write, n = runner.write_predictions, iter(range(10**6))

    def broken(*a):
        if next(n) == 5:
            raise KeyboardInterrupt
        write(*a)

    monkeypatch.setattr(runner, "write_predictions", broken)
    with pytest.raises(KeyboardInterrupt):
        example.steps(folder, [["run"]])
    monkeypatch.setattr(runner, "write_predictions", write)
    done = len(read_log(folder / "runs.history.jsonl"))
    assert 4 <= done < 24
    assert cli.main(["resolve", str(folder / "grid.yaml")]) == 1
    example.steps(folder, [["run"], ["run"], *example.after_runs(200)])
    history = read_log(folder / "runs.history.jsonl")
    assert len(history) == 24 == len({e["run"] for e in history}) and sum(e["status"] == "skipped" for e in history) == 6
    assert {c: v["status"] for c, v in Register(folder / "claims.jsonl").state().items()} == {"C1": "confirmed", "C2": "confirmed", "C3": "untested"}
    found = json.loads((folder / "verdicts.json").read_text())
    assert [v["outcome"] for v in found["verdicts"]] == ["effect", "no_effect"] and not any(v["oracle"] for v in found["verdicts"])
    assert {s["on"] for v in found["verdicts"] for s in v["selections"]} == {"validation"} and found["null_suite"]["k_of_n_cells"]["exact_claims"] == 0
    assert "[claim" not in capsys.readouterr().out
    text = (folder / "questions.yaml").read_text()
    (folder / "questions.yaml").write_text(text.replace("{select: [logreg, majority]}}", "{oracle_select: [logreg, majority]}}"))
    marked = project.decide(spark, folder / "questions.yaml", folder / "marked.json")["verdicts"]
    assert [v["oracle"] for v in marked] == [True, False]
    assert cli.main(["claims", "resolve", "--verdicts", str(folder / "marked.json"), "--log", str(folder / "claims.jsonl")]) == 1


def test_what_does_not_fit_is_refused(spark, folder):
    with pytest.raises(RuleError, match="takes no kk") as e:
        bad = "grid: g\nresolution: r\nextra: 1\nquestions:\n- {id: A, question: q, rule: k_of_n_cells, params: {cells: [c], a: x, b: y, kk: 1}}\n- {id: A, question: q, rule: none, params: {}}\n"
        (folder / "bad.yaml").write_text(bad)
        project.load_questions(folder / "bad.yaml")
    assert "needs k" in str(e.value) and "'extra'" in str(e.value) and "more than once" in str(e.value) and "no rule 'none'" in str(e.value)
    with pytest.raises(RunError, match="needs methods"):
        (folder / "bad.yaml").write_text("construct: construct.yaml\nfixture: f\nregistry: r\nother: 1\n")
        project.prepare(spark, folder / "bad.yaml")
    with pytest.raises(FixtureError, match="freeze it"):
        (folder / "other.yaml").write_text((folder / "fixtures.yaml").read_text().replace("0.25", "0.3"))
        project.locate(folder / "other.yaml", folder / "fixtures")


def test_label_function_of_the_project(spark, folder):
    from assayer.operators import freeze

    (folder / "labels.py").write_text("from pyspark.sql import functions as F\ndef rule(df):\n    return (F.col('enrollment') > 1500).cast('int')\n")
    text = (folder / "fixtures.yaml").read_text().replace("label_rule: {column: died}", "label_rule: {function: 'labels.py:rule'}, label_columns: [LABELS]")
    (folder / "f.yaml").write_text(text.replace("LABELS", "enrollment"))
    manifest, tables = freeze.load(spark, freeze.freeze(spark, folder / "f.yaml", folder / "fixtures"))
    assert 0 < tables["mortality"].where("label = 1").count() < tables["mortality"].count() == manifest["tasks"]["mortality"]["meta"]["rows_kept"]
    (folder / "f.yaml").write_text(text.replace("LABELS", "age"))
    with pytest.raises(FixtureError, match="label_columns"):
        freeze.freeze(spark, folder / "f.yaml", folder / "fixtures")


def test_a_rule_broken_on_purpose_fails_the_gate(spark):
    from pyspark.sql import functions as F

    def separate(rows, name, seen, unseen, draws=200, by=()):
        """Takes the drop of one method by itself for an effect."""
        from assayer.operators.resample import bootstrap_metric

        found = bootstrap_metric(rows.withColumnRenamed("score_a", "score"), [*by, "arm"], name, draws)
        side = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
        return found.groupBy(*by).agg(F.when(side(seen, "lo") > side(unseen, "hi"), "effect").otherwise("inconclusive").alias("outcome"))

    def points(found, k, name="roc_auc", by=()):
        """Counts point differences above zero, whatever their intervals."""
        return found.groupBy(*by).agg(F.when(F.count_if(F.col("point") >= 0) >= k, "effect").otherwise("no_effect").alias("outcome"))

    try:
        rules.rule("separate", rules.drop_nulls)(separate)
        rules.rule("points", rules.cell_nulls)(points)
        found = {r["rule"]: r for r in rules.null_suite(spark, ["separate", "points", "difference_of_drops", "k_of_n_cells"]).collect()}
        assert not found["separate"]["passed"] and found["separate"]["effects"] > 3
        assert not found["points"]["passed"] and found["points"]["exact_claims"] == 1
        assert found["difference_of_drops"]["passed"] and found["k_of_n_cells"]["passed"] and found["k_of_n_cells"]["exact_claims"] == 0
        with pytest.raises(RuleError, match="points"):
            rules.gate(spark, ["points"])
    finally:
        rules.RULES.pop("separate", None)
        rules.RULES.pop("points", None)


def test_small_groups_and_large_ones_draw_alike(spark, monkeypatch):
    from assayer.operators import resample

    rows = rules.null_pairs(spark, 3, 200).withColumn("cluster", F_cluster()).withColumn("score_b", rounded("score_b"))

    def both():
        out = [resample.paired_difference(rows, ["cell"], m, "score_a", "score_b", 30) for m in resample.RANKED]
        out += [resample.bootstrap_metric(rows.withColumnRenamed("score_b", "score"), [], "pr_auc", 30), resample.difference_in_differences(rows, "arm", "seen", "unseen", "roc_auc", "score_a", "score_b", 30, by=["cell"])]
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()) for df in out]

    small = both()
    monkeypatch.setattr(resample, "SMALL", 0)
    assert small == both() and all(small)


def F_cluster():
    from pyspark.sql import functions as F

    return (F.col("id").cast("long") % 40).cast("string")


def rounded(c):
    from pyspark.sql import functions as F

    return F.round(c, 1)


def test_edited_log_entries_are_found(spark, tmp_path):
    from assayer.operators.logs import append, broken_entries

    for i in range(4):
        append(tmp_path / "log", {"kind": "note", "body": f"é {i}", "a": [1, {"b": None}]})
    lines = (tmp_path / "log").read_text().splitlines()
    frame = lambda ls: spark.createDataFrame([("one", x) for x in ls], "log string, line string")
    assert broken_entries(frame(lines)).count() == 0
    lines[2] = lines[2].replace("é 2", "é 9")
    assert [r["seq"] for r in broken_entries(frame(lines)).collect()] == [3]
    assert {r["seq"] for r in broken_entries(frame(lines[:1] + lines[3:])).collect()} == {4}


def test_sources(spark, tmp_path):
    import hashlib
    import zipfile

    from assayer.sources.pinned import stacked, unpacked
    from assayer.sources.tables import columns_of, read_predictions, read_records

    parts = {"A/train_x.csv": "nct,age\nN1,5\nN2,6\n", "A/train_y.csv": "nct,Y/N\nN2,0\nN1,1\n", "A/test_x.csv": "nct,age\nN3,7\n", "A/test_y.csv": "nct,Y/N\nN3,1\n"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    sha = hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()
    with pytest.raises(FixtureError, match="not the pinned"):
        unpacked(tmp_path / "a.zip", "0" * 64, tmp_path / "raw")
    raw = unpacked(tmp_path / "a.zip", sha, tmp_path / "raw")
    assert unpacked(tmp_path / "gone.zip", sha, tmp_path / "raw") == raw
    names = {"cell": "phase_cell", "split": "shipped_split", "label": "label"}
    got = {(r["nct"], r["phase_cell"], r["shipped_split"], r["label"], r["age"]) for r in stacked(spark, raw, ["A"], ["train", "test"], "nct", "Y/N", names).collect()}
    assert got == {("N1", "A", "train", 1, 5), ("N2", "A", "train", 0, 6), ("N3", "A", "test", 1, 7)}
    (raw / "A/test_y.csv").write_text("nct,Y/N\nN9,1\n")
    with pytest.raises(FixtureError, match="A, test"):
        stacked(spark, raw, ["A"], ["train", "test"], "nct", "Y/N", names)
    assert columns_of(spark, str(raw / "A/train_x.csv")) == ["nct", "age"]
    (tmp_path / "p.csv").write_text("id,cluster,split,label,p_1,p_10,p_0\na,c,test,1,0.2,0.5,0.3\n")
    assert read_predictions(spark, str(tmp_path / "p.csv")).first()["probs"] == [0.3, 0.2, 0.5]
    (tmp_path / "q.csv").write_text("id,cluster,split,label,score\na,c,test,1,0.25\n")
    assert read_predictions(spark, str(tmp_path / "q.csv")).first()["probs"] == [0.75, 0.25]
    (tmp_path / "r/x").mkdir(parents=True)
    (tmp_path / "r/x/1.json").write_text('{"run": "a"}')
    (tmp_path / "r/2.json").write_text('{"run": ')
    good, bad = read_records(spark, str(tmp_path / "r"), "run string")
    assert [r["run"] for r in good.collect()] == ["a"] and [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["2.json"]
